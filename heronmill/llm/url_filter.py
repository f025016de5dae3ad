"""URL filters: rules first, then naive Bayes over segmented host and path words.

1. A url's host is what stands after the first ``://`` up to ``/``, ``?``, ``#`` or the
   end, with A-Z in lower case; its path is what follows up to ``?``, ``#`` or the end.
   A rule ``host/path`` fits its host and all subdomains when the path starts with the
   rule's, which has the slash; the longest rule wins.
2. Host labels and path parts are cut at what is not a letter; a run of digits stands for
   its length. A unigram model splits each piece by Viterbi, so that names written together
   come apart. Its words are a short fixed list and the words of a corpus of texts with a share
   of ``WORD_SHARE`` or more; urls are not counted, so a name never makes itself a word. What is unknown
   costs much once and little for each letter, so that a word is never split off from an unknown
   rest (pillowstore, specialist).
3. Multinomial naive Bayes with features by word and place (host or path). Words that sites use
   which a corpus leaves out have fixed prior odds, halved in paths, where they are often spoken about.
   All other words have odds learned from the urls that a rule judges: the ratio of the smoothed shares that a word has of
   the words of blocked and of allowed urls. (Rules judge whole domains, whatever their names, so they do not weaken a fixed word.) A third of the hosts is left out of learning, for tests.
4. Urls that no rule fits get the class with the larger posterior.

All thresholds and smoothing are shares, so that a verdict does not follow the size of a table: it changes
only where shares do. A share bounds the number of words: at most ``1 / WORD_SHARE`` words of texts and
``2 / ODDS_SHARE`` learned odds go to the driver and the tasks, whatever the tables hold.

Defined cases: a null url or one without ``://`` has an empty host and path, no rule,
and the verdict of the prior, which is allow; ties go to allow. Null texts have no words. Extra columns are not touched.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronmill.llm.shared import arrow_pass, stored

#: The rules of the query's contract.
RULES = (
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
)
#: Words of sites that a corpus leaves out, by the log-odds that one in a host's name has.
STRONG, MEDIUM, WEAK = 4.0, 2.5, 1.0
SEEDS = dict.fromkeys("casino cialis escort gambling keygen nude payday porn viagra warez xxx".split(), STRONG)
SEEDS |= dict.fromkeys(
    """adult bet bets betting bingo cams crack dating loan loans pharmacy pill pills poker replica sex slots spam
    torrent""".split(), MEDIUM
)
SEEDS |= dict.fromkeys("best bonus buy cheap discount free hot live online win".split(), WEAK)
#: Words that stand in any url and carry no sign of either class.
COMMON = frozenset("www blog news shop mail mobile example index html page feed wiki docs home store en de fr es com net org".split())
PIECE = re.compile(r"[^\W\d_]+|\d+")
#: The log-odds of a blocked url before it is read, and what a seed in a path has of its odds.
PRIOR, IN_PATH = -3.0, 0.5
#: The share of each word of the fixed list, and the least share of words of texts.
LISTED_SHARE, WORD_SHARE = 1e-3, 2e-5
#: What an unknown piece costs, in all and for each letter.
UNKNOWN, LETTER = 20.0, 0.1
#: The least share of a learned word in either class, and the share that smooths both.
ODDS_SHARE, SMOOTH = 1e-4, 1e-3


def host_of(url: Column) -> Column:
    raw = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(raw, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str], ...]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, or nulls."""
    rule = verdict = F.lit(None).cast("string")
    for text, kind in sorted(rules, key=lambda r: len(r[0])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


class Segmenter:
    """Viterbi splits under a unigram model: words and their shares."""

    def __init__(self, shares: dict[str, float], longest: int = 20):
        self.cost = {w: -math.log(p) for w, p in shares.items() if len(w) <= longest}
        self.longest = longest
        self.known: dict[str, list[str]] = {}

    def __call__(self, piece: str) -> list[str]:
        found = self.known.get(piece)
        if found is None:
            if len(self.known) > 100_000:
                self.known.clear()
            found = self.known[piece] = self.split(piece)
        return found

    def split(self, piece: str) -> list[str]:
        best, back = [0.0], [0]
        for end in range(1, len(piece) + 1):
            cost, start = math.inf, end - 1
            for begin in range(max(0, end - self.longest), end):
                word = piece[begin:end]
                # Fewer letters of an unknown word never pay for one more word.
                own = self.cost.get(word, UNKNOWN + LETTER * len(word))
                if best[begin] + own < cost:
                    cost, start = best[begin] + own, begin
            best.append(cost)
            back.append(start)
        out, end = [], len(piece)
        while end:
            out.append(piece[back[end] : end])
            end = back[end]
        return out[::-1]


def words_of(host: str, path: str, cut: Segmenter) -> list[str]:
    """Features: the words of the host and, with a slash before them, those of the path."""

    def words(text: str) -> Iterator[str]:
        for p in PIECE.findall(text):
            if p.isdigit():
                yield f"#{len(p)}"
            else:
                yield from (w for w in cut(p) if w not in COMMON)

    return [*words(host), *("/" + w for w in words(path.lower()))]


def unigrams(texts: DataFrame | None, text_col: str) -> dict[str, float]:
    """Shares of the fixed words and of the frequent words of ``texts``."""
    listed = dict.fromkeys([*SEEDS, *COMMON], LISTED_SHARE)
    if texts is None:
        return listed

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                n.update(p for p in PIECE.findall((text.as_py() or "").lower()) if not p.isdigit())
            if len(n) > 200_000:
                yield {"word": list(n), "n": list(n.values())}
                n.clear()
        yield {"word": list(n), "n": list(n.values())}

    counts = stored(
        arrow_pass(texts.select(text_col), "word string, n long", count).groupBy("word").agg(F.sum("n").alias("n")), "url-words"
    )
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return listed
    return {r.word: r.n / total for r in counts.where(F.col("n") >= WORD_SHARE * total).collect()} | listed


def learned(urls: DataFrame, cut: Segmenter) -> dict[str, float]:
    """Log-odds of features from (host, path, fixed), where ``fixed`` is the verdict of a rule."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n: tuple[Counter, Counter] = (Counter(), Counter())

        def rows() -> dict:
            seen = [*(n[0].keys() | n[1].keys())]
            return {"word": seen, "allow": [n[0][w] for w in seen], "block": [n[1][w] for w in seen]}

        for batch in batches:
            for host, path, fixed in zip(*(c.to_pylist() for c in batch.columns)):
                n[fixed == "block"].update(words_of(host, path, cut))
            if len(n[0]) + len(n[1]) > 200_000:
                yield rows()
                n = (Counter(), Counter())
        yield rows()

    kept = urls.where("fixed IS NOT NULL").where(F.pmod(F.xxhash64("host"), F.lit(3)) != 1)
    rows = arrow_pass(kept.select("host", "path", "fixed"), "word string, allow long, block long", count)
    rows = stored(rows.groupBy("word").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "url-odds")
    total = rows.agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).first()
    if not total.allow or not total.block:
        return {}
    shares = rows.select("word", *((F.col(c) / F.lit(total[c])).alias(c) for c in ("allow", "block")))
    frequent = shares.where(F.greatest("allow", "block") >= ODDS_SHARE).collect()
    return {r.word: math.log((r.block + SMOOTH) / (r.allow + SMOOTH)) for r in frequent if r.word.lstrip("/") not in SEEDS}


def seed_odds(feature: str) -> float:
    return IN_PATH * SEEDS.get(feature[1:], 0.0) if feature.startswith("/") else SEEDS.get(feature, 0.0)


def judge(
    pages: DataFrame,
    texts: DataFrame | None = None,
    id_col: str = "page_id",
    url_col: str = "url",
    text_col: str = "text",
    rules: tuple[tuple[str, str], ...] = RULES,
) -> DataFrame:
    """(page, host, path, rule, verdict) of every row of ``pages``; ``texts`` give words for the segmentation."""
    url = F.col(url_col)
    parts = pages.select(F.col(id_col).alias("page"), host_of(url).alias("host"), path_of(url).alias("path"))
    rule, fixed = rule_of(F.col("host"), F.col("path"), rules)
    rows = parts.select("page", "host", "path", rule.alias("rule"), fixed.alias("fixed"))
    shares = unigrams(texts, text_col)
    odds = learned(rows, Segmenter(shares))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        cut = Segmenter(shares)
        for batch in batches:
            verdicts = []
            for host, path, known in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "fixed"))):
                if known is None:
                    total = PRIOR + sum(seed_odds(w) + odds.get(w, 0.0) for w in words_of(host, path, cut))
                    known = "block" if total > 0 else "allow"
                verdicts.append(known)
            yield {c: batch.column(c) for c in ("page", "host", "path", "rule")} | {"verdict": verdicts}

    kind = dict(parts.dtypes)["page"]
    return arrow_pass(rows, f"page {kind}, host string, path string, rule string, verdict string", score)


def digest(pages: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """Rows of query op4."""
    return judge(pages, texts).withColumnRenamed("page", "page_id")
