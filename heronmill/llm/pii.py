"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Base kinds, whose spans always stay: e-mail and IP addresses, card numbers (Luhn) and phone
numbers with a plus sign. The method adds spans that do not overlap these:

* IBANs whose mod-97 is 1 and whose length is that of their country, where it is known;
* IPv6 addresses, card numbers of 13 to 15 digits, phone numbers without a plus sign and
  e-mail addresses with a spelled ``(at)``.

Each proposal has a prior score of its kind. A passed checksum raises it, words that speak of
the kind within ``AROUND`` code points raise it, words that speak of other numbers lower it.
Added spans stay from a score of ``THRESHOLD``.

Every pattern reads a text once: e-mail addresses are sought from their ``@``, digits from where
a run of them begins, so that a long text without a match takes no longer than one with many.

Defined cases: null texts are empty; an empty table gives an empty one; every row is judged by
itself, so null and repeated ids change nothing; extra columns stay, but for those that have
the name of a new one.
"""

from __future__ import annotations

import ipaddress
import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heronmill.llm.shared import arrow_pass

KINDS = ("email", "ip", "card", "phone", "iban")
BASE_KINDS = KINDS[:4]
THRESHOLD = 0.6
AROUND = 48
SPANS = "array<struct<kind: string, start: int, end: int, score: double, base: boolean>>"

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
SPELLED_AT = re.compile(
    r"[ ]?[\[({][ ]?(?:at|AT|At)[ ]?[\])}][ ]?[A-Za-z0-9-]++(?:(?:\.|[ ]?[\[({][ ]?(?:dot|DOT|Dot)[ ]?[\])}][ ]?)[A-Za-z0-9-]++)+"
)
IP4 = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
IP6 = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f]*:)[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:.])")
DIGIT_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])++")
PLUS_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOCAL_PHONE = re.compile(r"(?<![\w+(.-])\(?[0-9]{2,5}\)?[ ./-][0-9]{3,4}[ .-]?[0-9]{3,5}(?![\w-])")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]){11,30}")
WORD = re.compile(r"[^\W\d_]+")

#: Lengths of IBANs by country, as the registry of ISO 13616 has them.
IBAN_LENGTHS = dict(
    AT=20, BE=16, BG=22, CH=21, CY=28, CZ=24, DE=22, DK=18, EE=20, ES=24, FI=18, FR=27, GB=22, GR=27, HR=21, HU=28,
    IE=22, IS=26, IT=27, LI=21, LT=20, LU=20, LV=21, MC=27, MT=31, NL=18, NO=15, PL=28, PT=25, RO=24, SE=24, SI=19,
    SK=24, TR=26, SA=24, AE=23, IL=23, BR=29,
)
#: Words that speak of a kind, in lower case.
SPEAKS_OF = {
    "email": frozenset("mail email contact write schreib kontakt correo escribe courriel écrire adresse address".split()),
    "ip": frozenset("ip ipv address host server client login adresse dirección serveur".split()),
    "card": frozenset("card credit debit visa mastercard amex diners karte kreditkarte tarjeta crédito carte crédit bancaire cc".split()),
    "phone": frozenset("phone tel telephone call mobile cell fax ring telefon handy anrufen teléfono móvil llame téléphone appelez portable".split()),
    "iban": frozenset("iban account bank transfer konto überweisung cuenta banco transferencia compte banque virement bic".split()),
}
SPEAKS_AGAINST = frozenset("isbn issn order invoice version serial tracking bestellung rechnung pedido factura commande facture".split())
#: A proposal's score before its words are read.
PRIOR = {"email": 0.5, "ip": 0.5, "card": 0.2, "phone": 0.4, "iban": 0.3}
CONFIRMED, SPOKEN_OF, SPOKEN_AGAINST = 0.35, 0.25, -0.3


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float
    base: bool


def luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in doubled)) % 10 == 0


def mod97(iban: str) -> bool:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def base_emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``."""
    free = 0  # nothing before belongs to a further match
    for m in AT_DOMAIN.finditer(text):
        free = max(free, text.rfind("@", free, m.start()) + 1)
        begin = free + len(text[free : m.start()].rstrip(LOCAL))
        if begin < m.start():
            yield begin, m.end()
            free = m.end()


def base_ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP4.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield m.span()


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def chains(text: str) -> Iterator[tuple[int, int, str]]:
    for m in DIGIT_CHAIN.finditer(text):
        if m.end() - m.start() >= 13:
            yield *m.span(), digits_of(m[0])


def base_phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PLUS_PHONE.finditer(text):
        if 8 <= len(digits_of(m[0])) <= 15:
            yield m.span()


def score(kind: str, text: str, start: int, end: int, confirmed: bool) -> float:
    """The prior of a kind, raised by a checksum and moved by the words around."""
    near = text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]
    words = set(WORD.findall(near.lower()))
    out = PRIOR[kind] + CONFIRMED * confirmed
    out += SPOKEN_OF * (not words.isdisjoint(SPEAKS_OF[kind]))
    out += SPOKEN_AGAINST * (not words.isdisjoint(SPEAKS_AGAINST))
    return round(min(1.0, max(0.0, out)), 2)


def ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in IBAN.finditer(text):
        letters, ends = [], []
        for i, c in enumerate(m[0]):
            if c != " ":
                letters.append(c)
                ends.append(m.start() + i + 1)
        known = IBAN_LENGTHS.get(m[0][:2])
        for n in [known] if known else range(len(letters), 14, -1):
            if n > len(letters):
                continue
            follows = text[ends[n - 1] : ends[n - 1] + 1]
            if not follows.isalnum() and mod97("".join(letters[:n])):
                yield m.start(), ends[n - 1]
                break


def ip6_confirmed(s: str) -> bool:
    try:
        ipaddress.IPv6Address(s)
    except ValueError:
        return False
    return True


def proposals(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """Further spans: kind, place, and whether a check confirms them."""
    for m in SPELLED_AT.finditer(text):
        begin = m.start()
        while begin and text[begin - 1] in LOCAL and m.start() - begin < 64:
            begin -= 1
        if begin < m.start():
            yield "email", begin, m.end(), False
    if text.count(":") > 1:
        for m in IP6.finditer(text):
            if ip6_confirmed(m[0]) and sum(map(bool, m[0].split(":"))) >= 2:
                # With few groups it may as well be a name of a program.
                yield "ip", *m.span(), sum(map(bool, m[0].split(":"))) >= 4
    for start, end, digits in chains(text):
        brand = {13: ("4",), 14: ("30", "36", "38"), 15: ("34", "37")}.get(len(digits))
        if brand and digits.startswith(brand) and luhn(digits):
            yield "card", start, end, True
    for m in LOCAL_PHONE.finditer(text):
        if 8 <= len(digits_of(m[0])) <= 12:
            yield "phone", *m.span(), False
    for start, end in ibans(text):
        yield "iban", start, end, text[start : start + 2] in IBAN_LENGTHS


def apart(base: list[Span], added: list[Span]) -> list[Span]:
    """Added spans that overlap no base span; of those that overlap each other, the best score stays, then the longest."""
    if not added:
        return []
    taken: list[tuple[int, int]] = []  # disjoint and in order
    for a, b in sorted((s.start, s.end) for s in base):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
        else:
            taken.append((a, b))
    out = []
    for s in sorted(added, key=lambda s: (-s.score, s.start - s.end, s.start)):
        i = bisect_left(taken, (s.start, s.end))
        if (i == len(taken) or s.end <= taken[i][0]) and (not i or taken[i - 1][1] <= s.start):
            taken.insert(i, (s.start, s.end))
            out.append(s)
    return out


def spans_of(text: str | None) -> list[Span]:
    """All spans of a text, by kind as in ``KINDS`` and then by start."""
    if not text:
        return []
    found: list[Span] = []
    if "@" in text:
        found += [Span("email", a, b, score("email", text, a, b, False), True) for a, b in base_emails(text)]
    found += [Span("ip", a, b, score("ip", text, a, b, False), True) for a, b in base_ips(text)]
    for a, b, digits in chains(text):
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(Span("card", a, b, score("card", text, a, b, True), True))
    if "+" in text:
        found += [Span("phone", a, b, score("phone", text, a, b, False), True) for a, b in base_phones(text)]
    more = (Span(kind, a, b, score(kind, text, a, b, ok), False) for kind, a, b, ok in proposals(text))
    found += apart(found, [s for s in more if s.score >= THRESHOLD])
    return sorted(found, key=lambda s: (KINDS.index(s.kind), s.start))


def find_spans(docs: DataFrame, text_col: str = "text", out: str = "pii", keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all) and ``out``, the spans of the whole text in code points, end exclusive."""
    names = [c for c in (docs.columns if keep is None else keep) if c != out]
    # The text comes last, so that it need not come back where it is not kept.
    source = docs.select(*(F.col(f"`{c}`") for c in names), F.col(f"`{text_col}`"))
    schema = StructType(source.schema.fields[:-1] + StructType.fromDDL(f"`{out}` {SPANS}").fields)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            own = {c: batch.column(i) for i, c in enumerate(names)}
            texts = batch.column(len(names))
            yield own | {out: [[s._asdict() for s in spans_of(t.as_py())] for t in texts]}

    return arrow_pass(source, schema, rows)


def redacted(docs: DataFrame, text_col: str = "text", least: float = 0.0) -> DataFrame:
    """``docs`` with each span of a score of ``least`` or more replaced by its kind in brackets; null stays null.

    Of spans that overlap, the first one's kind stands for all that they cover together.
    """
    names = docs.columns
    schema = docs.schema

    def masked(text: str | None) -> str | None:
        if not text:
            return text
        out, end = [], 0
        for s in sorted((s for s in spans_of(text) if s.score >= least), key=lambda s: (s.start, -s.end)):
            if s.start >= end:
                out += [text[end : s.start], f"[{s.kind}]"]
            end = max(end, s.end)
        return "".join([*out, text[end:]])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            own = {c: batch.column(i) for i, c in enumerate(names)}
            yield own | {text_col: [masked(t.as_py()) for t in own[text_col]]}

    return arrow_pass(docs, schema, rows)


def as_text(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    one = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(one, ",")


def digest(docs: DataFrame) -> DataFrame:
    """Rows of query op13; the numbers are those of base spans."""
    base = F.filter("pii", lambda s: s["base"])

    def number(kind: str) -> Column:
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return find_spans(docs, keep=["doc_id"]).select(
        "doc_id", *map(number, BASE_KINDS), F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("pii")).alias("spans")
    )
