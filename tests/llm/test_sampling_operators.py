"""Importance resampling, fill-in-middle and personal data against brute force on small tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heronmill.llm import fill_middle, importance, pii, queries, sql

RND = random.Random(11)
SF = "/root/testdata/sf0.001"
TEXTS = [
    None, "", " ", "\n", "\n\n", "one", "A b\nc\n\nd e f", "no end\nof line", "x" * 3000, "été Ünïcode 日本 語\n🙂 tail\n",
    "has <S> inside\nline", "almost < P> <P <\nS>\n", "a\r\nb\n", "\n".join(f"line {i} of many" for i in range(90)),
    " ".join(RND.choice(["red", "Green", "blue", "x1", "été"]) for _ in range(400)), "same words here " * 12, "same words here " * 12,
]


def table(spark, texts, ids=None):
    rows = list(zip(ids or range(len(texts)), texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    extra = ("n", "form", "_key", "_plan", "entry", "before", "marked", "key", "pii", "_range", "rank", "score", "weight", "lang", "_of")
    return df.select("*", *(F.lit("extra").alias(c) for c in extra))


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


# 11 importance resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return w, [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def importance_by_hand(rows, target, buckets=10_000):
    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = Counter(), Counter()
    for _, text in rows:
        s.update(map(bucket, grams(text)[1]))
    for text in target:
        t.update(map(bucket, grams(text)[1]))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log(((t[b] + 1) * (n_s + buckets)) / ((s[b] + 1) * (n_t + buckets))))
    out = []
    for ident, text in rows:
        words, own = grams(text)
        weight = sum(gain(bucket(g)) for g in own)
        h = int(hashlib.sha256(f"42:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        out.append([ident, len(words), len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    some = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0, -r[3], -r[2]))
    drawn = {id(r): k + 1 for k, r in enumerate(some[: 5 * len(some) // 100])}
    return Counter((r[0], r[2], r[3], r[4], drawn.get(id(r))) for r in out)


def test_importance_equals_brute_force(spark):
    rnd = random.Random(5)
    texts = TEXTS + [" ".join(rnd.choice(["red", "sum", "Of", "the", "ünd", "7"]) for _ in range(rnd.randint(15, 60))) for _ in range(90)]
    ids = [None, 3, 3, *range(3, len(texts))]
    target = ["The sum of the red 7", None, "", "of ünd"]
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    want = importance_by_hand(list(zip(ids, texts)), target)
    got = Counter(tuple(r) for r in importance.digest(table(spark, texts, ids), bench).collect())
    assert got == want
    assert sum(k[4] is not None for k in want.elements()) >= 4


def test_windows_do_not_change_features():
    rnd = random.Random(8)
    texts = [" ".join("".join(rnd.choice("abÉ") for _ in range(rnd.randint(1, 90))) for _ in range(rnd.randint(0, 80))) for _ in range(30)]
    texts += ["", None, "q" * 400, "a b", "  ", "word\nword"]

    def counts(most):
        n = np.zeros((len(texts), 97), int)
        for words in importance.windows(pa.array(texts, pa.string()), most):
            for doc, bucket in importance.features(words, 97):
                np.add.at(n, (doc, bucket), 1)
        return n

    want = np.zeros((len(texts), 97), int)
    for i, text in enumerate(texts):
        for g in grams(text)[1]:
            want[i, zlib.crc32(g.encode()) % 97] += 1
    for most in (1, 7, 50, 1000, 1 << 22):
        assert (counts(most) == want).all()
    half = pa.array(["zz zz", *texts, "yy"], pa.string()).slice(1, len(texts))
    assert sum(len(b) for w in importance.windows(half) for _, b in importance.features(w, 97)) == want.sum()


def test_importance_of_empty_tables_and_drawn_rows(spark):
    docs = table(spark, TEXTS)
    bench = spark.createDataFrame([], "text string")
    assert importance.digest(docs.limit(0), bench).count() == 0
    assert Counter(tuple(r) for r in importance.digest(docs, bench).collect()) == importance_by_hand(list(enumerate(TEXTS)), [])
    kept = importance.drawn(docs, bench, percent=50)
    assert kept.columns == docs.columns and kept.count() == 2


# 12 fill-in-middle


def fill_by_hand(ident, text, marks=("<P>", "<S>", "<M>")):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = sha(f"7:{'' if ident is None else ident}")
    h = [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]
    n = len(units)
    if not text or any(m in text for m in marks):
        return n, "plain", None, None, sha(text), sha(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    spm = h[3] % 100 < 50
    out = f"{marks[1]}{s}{marks[0]}{p}{marks[2]}{m}" if spm else f"{marks[0]}{p}{marks[1]}{s}{marks[2]}{m}"
    return n, "spm" if spm else "psm", len(p), len(m), sha(out), sha(text)


@pytest.mark.parametrize("chunk", [1, 5, 64, 1 << 20])
def test_fill_middle_equals_brute_force(spark, chunk):
    texts = TEXTS + ["<" * 9, "x<P" + ">" + "y", "ends with <P", "\n" * 40]
    ids = [None, 7, 7, *range(7, len(texts) + 4)]
    got = Counter((r[0], *r[1:]) for r in fill_middle.digest(table(spark, texts, ids), chunk=chunk).collect())
    assert got == Counter((i, *fill_by_hand(i, t)) for i, t in zip(ids, texts))
    assert fill_middle.digest(table(spark, texts, ids).limit(0), chunk=chunk).count() == 0


def test_fill_middle_keeps_other_columns(spark):
    docs = table(spark, TEXTS)
    out = fill_middle.fill_middle(docs, chunk=8, unit="paragraph")
    assert out.columns == [c for c in docs.columns if c not in fill_middle.ADDED] + list(fill_middle.ADDED)
    back = out.select("doc_id", "entry", fill_middle.restored("output", "form").alias("text"))
    assert {r.doc_id: (r.entry, r.text) for r in back.collect()} == {i: ("extra", t or "") for i, t in enumerate(TEXTS)}
    plain = fill_middle.fill_middle(docs, fim_percent=0).where("form <> 'plain'")
    assert plain.count() == 0


@pytest.mark.parametrize("unit", ["line", "paragraph", "words"])
def test_automata_by_chunks(unit):
    """Units and their places, from pieces cut anywhere, against a loop over characters."""
    auto = fill_middle.containing(["ab", "aba", "bb"]) if unit == "words" else fill_middle.UNITS[unit]()
    rnd = random.Random(3)
    for _ in range(300):
        text = "".join(rnd.choice("ab\n\nc" if unit != "words" else "abc") for _ in range(rnd.randint(0, 40)))
        state, starts = 0, []
        for i, c in enumerate(text):
            kind = auto.lookup[min(ord(c), auto.top)]
            if auto.begins[kind][state]:
                starts.append(i)
            state = auto.table[kind][state]
        size = rnd.randint(1, 9)
        parts = [text[i : i + size] for i in range(0, len(text), size)] or [""]
        entry, before, n = fill_middle.composed([auto.scan(p) for p in parts])
        assert n == len(starts)
        assert [fill_middle.offset(text, k, auto, size, entry, before, n) for k in range(n + 1)] == [*starts, len(text)]
        if unit == "line":
            assert n == len(re.findall(r"[^\n]*\n|[^\n]+", text))
        if unit == "words":
            assert n == sum(any(text[: i + 1].endswith(w) for w in ("ab", "aba", "bb")) for i in range(len(text)))


# 13 personal data

BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in s.split("."))
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def base_by_hand(text):
    return [
        (kind, m.start(), m.end()) for kind, p in BASE.items() for m in re.finditer(p, text or "") if passes(kind, m[0])
    ]


PERSONAL = [
    None, "", "mail a.b@c.de, x@y, @z.com, a@b.c@d.e f@g..h i@-.j", "1.2.3.4 256.1.1.1 1.2.3.4.5 01.002.3.4 9.9.9 1.1.1.1.1.1.1.1",
    "4111 1111 1111 1111 and 4111-1111-1111-1112, 4111111111111111 4", "+1 (212) 555-0199. +49 30 1234567 +1 +12 +123456789012345678",
    "a@b.co+1 234 567 890 1.2.3.4@x.yz", "é+1 2345678é 4242 4242 4242 4242\n", "x" * 4000 + "@", "9" * 5000 + ".1.2.3", "@" * 500, "1." * 900,
    "a@" * 700 + "b.c", "+1" * 300, "12 " * 800,
]


def test_base_spans_equal_the_patterns(spark):
    rnd = random.Random(2)
    alphabet = ["a", "B", "@", ".", "1", "23", "+", "-", " ", "(", "4111111111111111", "x@y.z", "\n", "é", "255", "%"]
    texts = PERSONAL + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 40))) for _ in range(1500)]
    rows = pii.digest(table(spark, texts)).collect()
    for r in rows:
        want = base_by_hand(texts[r.doc_id])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert r.base_sha256 == sha(text), texts[r.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in want) for kind in BASE]
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))
    assert len(rows) == len(texts)
    assert pii.digest(table(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, kind, value",
    [
        ("My IBAN is DE89 3704 0044 0532 0130 00 AND MORE", "iban", "DE89 3704 0044 0532 0130 00"),
        ("transfer to GB82WEST12345698765432.", "iban", "GB82WEST12345698765432"),
        ("my amex card 3782 822463 10005 please", "card", "3782 822463 10005"),
        ("server host 2001:db8:85a3::8a2e:370:7334 down", "ip", "2001:db8:85a3::8a2e:370:7334"),
        ("call me at 030 1234 5678 today", "phone", "030 1234 5678"),
        ("write to jane.doe (at) example (dot) com now", "email", "jane.doe (at) example (dot) com"),
    ],
)
def test_added_spans(text, kind, value):
    found = [(s.kind, text[s.start : s.end]) for s in pii.spans_of(text) if not s.base]
    assert found == [(kind, value)]


@pytest.mark.parametrize(
    "text",
    [
        "DE89 3704 0044 0532 0130 01 IBAN account",  # mod 97 fails
        "std::vector a::b 12:30:45 10:20",
        "numbers 030 1234 5678 alone, 378282246310005 too",  # no word speaks of them
        "order invoice 3782 822463 10005 tracking",
        "token = 9233A8ECF7C5B09FE5949719B6B82BC439E9329B",
    ],
)
def test_left_alone(text):
    assert pii.spans_of(text) == []


def test_redaction(spark):
    texts = ["a@b.co and +1 (212) 555-0199", None, "", "nothing", "ip 1.2.3.4@x.yz"]
    out = pii.redacted(table(spark, texts))
    assert out.columns == table(spark, texts).columns
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {0: "[email] and [phone]", 1: None, 2: "", 3: "nothing", 4: "ip [email]"}


@pytest.mark.parametrize("name, text", [("op11_importance", sql.IMPORTANCE), ("op12_fill_middle", sql.FILL_MIDDLE)])
def test_queries_equal_sql(spark, name, text):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    assert Counter(map(tuple, df.collect())) == Counter(con.sql(text).fetchall())


def test_personal_data_of_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r.base_sha256 for r in queries.QUERIES["op13_pii"](spark, SF).collect()}
    assert got == {d.doc_id: sha(",".join(f"{k}:{a}:{b}" for k, a, b in base_by_hand(d.text))) for d in docs}
