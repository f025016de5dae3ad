"""Weighted search terms of a text without a dictionary, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}"
EXACT, WORD, PAIR, PHRASE = 3.0, 2.0, 1.0, 4.0
MOST_TERMS, MOST_PHRASES, LONGEST_PHRASE = 8, 4, 12
TERM = "array<struct<text:string,weight:double>>"


def runs(text: Column) -> Column:
    """Maximal runs of letters and digits, cut where the script changes."""
    return F.regexp_extract_all(text, F.lit(rf"[{CJK}]+|[\p{{L}}\p{{Nd}}&&[^{CJK}]]+"), F.lit(0))


def spans(text: Column) -> Column:
    """Maximal runs of letters and digits of any script."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{Nd}]+"), F.lit(0))


def term(text: Column, weight: float) -> Column:
    return F.struct(text.alias("text"), F.lit(weight).alias("weight"))


def run_terms(run: Column, words: tuple[str, ...] = ()) -> Column:
    """A run's terms: itself, known words in it, or its adjacent pairs."""
    n = F.char_length(run)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: term(F.substr(run, i, F.lit(2)), PAIR))
    long = pairs
    if words:
        known = F.regexp_extract_all(run, F.lit("|".join(sorted(words, key=lambda w: (-len(w), w)))), F.lit(0))
        found = F.transform(known, lambda w: term(w, WORD))
        long = F.when(F.size(known) > 0, found).otherwise(pairs)
    none = F.array().cast(TERM)
    return (
        F.when(n < 2, none)
        .when(~run.rlike(f"^[{CJK}]"), F.array(term(run, EXACT)))
        .when(n == 2, F.array(term(run, WORD)))
        .otherwise(long)
    )


def first_wins(terms: Column) -> Column:
    """Terms without later ones that differ in case only."""
    return F.filter(
        terms, lambda t, i: ~F.exists(F.slice(terms, F.lit(1), i), lambda e: F.lower(e["text"]) == F.lower(t["text"]))
    )


def terms(text: Column, words: tuple[str, ...] = ()) -> Column:
    """At most eight terms: exact ones first, then words, then pairs."""
    found = F.flatten(F.transform(runs(text), lambda r: run_terms(r, words)))

    def of_weight(weight: float) -> Column:
        return F.filter(found, lambda t: t["weight"] == weight)

    ordered = F.concat(*map(of_weight, (EXACT, WORD, PAIR)))
    return F.slice(first_wins(ordered), F.lit(1), F.lit(MOST_TERMS))


def phrases(text: Column, words: tuple[str, ...] = ()) -> Column:
    """At most four spans that are no terms."""
    own = F.transform(terms(text, words), lambda t: F.lower(t["text"]))
    good = F.filter(
        F.array_distinct(spans(text)),
        lambda s: F.char_length(s).between(2, LONGEST_PHRASE) & s.rlike(f"[{CJK}]") & ~F.array_contains(own, F.lower(s)),
    )
    return F.transform(F.slice(good, F.lit(1), F.lit(MOST_PHRASES)), lambda s: term(s, PHRASE))
