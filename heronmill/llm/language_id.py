"""Language ID by rank-order profiles.

A text's letters, in lower case with everything else as single spaces, give
n-grams of one to three code points that do not cross a word. A language's profile
is its most frequent n-grams in order; a document's own most frequent n-grams are
compared with each profile by out-of-place distance: the sum of the differences of
ranks, where an n-gram that the profile lacks counts as the profile's length. The
smallest distance wins, ties going to the language that sorts first.

Profiles are learned from a sample of at most about ``learn_rows`` labelled
documents, taken by a hash of the id, so the same ones at every run; what reaches
the driver is ``profile`` n-grams for each language. Prediction reads whole texts.

Defined cases: a text that is null or has no letter is ``und`` with score 0, and
so is every text when nothing can be learned; rows with a null id are predicted
and never learned from. The score is how far the best distance lies below the
second best, from 0 to 1. Extra columns are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heronmill.llm.shared import arrow_pass

NOT_LETTERS = re.compile(r"[\W\d_]+")
SPACE = np.uint64(32)


def grams(text: str | None) -> np.ndarray:
    """The n-grams of a text as numbers of 21 bits for each code point; empty without letters."""
    s = NOT_LETTERS.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, s)):
        return np.empty(0, np.uint64)
    c = np.frombuffer(f" {s} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    two = (c[:-1] << np.uint64(21)) | c[1:]
    three = (two[:-1] << np.uint64(21)) | c[2:]
    return np.concatenate([c[c != SPACE], two, three[c[1:-1] != SPACE]])


def ranked(found: np.ndarray, top: int) -> np.ndarray:
    """The ``top`` most frequent n-grams, most frequent first."""
    values, counts = np.unique(found, return_counts=True)
    if len(values) > top:
        least = np.partition(counts, -top)[-top]
        keep = counts >= least
        values, counts = values[keep], counts[keep]
    return values[np.lexsort((values, -counts))][:top]


def profiles(docs: DataFrame, id_col: str, text_col: str, lang_col: str, rows: int, top: int) -> dict[str, np.ndarray]:
    """Each language's n-grams in rank order, from about ``rows`` of its documents."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    known = known.select(F.col(id_col).cast("long").alias("doc"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    # A share of each language, so that a rare one keeps its profile however large the table is.
    share = known.groupBy("lang").agg(F.least(F.lit(1.0), F.lit(float(rows)) / F.count("*")).alias("share"))
    chosen = F.pmod(F.xxhash64("doc"), F.lit(1 << 52)) < F.col("share") * float(1 << 52)
    known = known.join(share, "lang").where(chosen)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            parts: dict[str, list[np.ndarray]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts.setdefault(lang, []).append(grams(text))
            for lang, own in parts.items():
                values, n = np.unique(np.concatenate(own), return_counts=True)
                yield {"lang": [lang] * len(values), "gram": values.astype(np.int64), "n": n}

    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = (
        arrow_pass(known.select("lang", "text"), "lang string, gram long, n long", counts)
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= top)
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("rank", "gram"))).alias("grams"))
    )
    return {r.lang: np.array([g.gram for g in r.grams], np.uint64) for r in best.collect()}


class OutOfPlace:
    """Distances of one document's ranking to each profile."""

    def __init__(self, ranks: dict[str, np.ndarray], top: int):
        self.top = top
        self.langs = sorted(ranks)
        self.sorted = []
        for lang in self.langs:
            order = np.argsort(ranks[lang])
            self.sorted.append((ranks[lang][order], order))

    def __call__(self, own: np.ndarray) -> np.ndarray:
        here = np.arange(len(own))
        out = np.empty(len(self.langs))
        for k, (values, rank) in enumerate(self.sorted):
            at = np.minimum(np.searchsorted(values, own), len(values) - 1)
            apart = np.where(values[at] == own, np.abs(rank[at] - here), self.top)
            out[k] = np.minimum(apart, self.top).sum()
        return out


def detect(
    docs: DataFrame,
    learn_from: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    learn_rows: int = 5_000,
    top: int = 300,
) -> DataFrame:
    """(doc, lang_pred, score) of every row of ``docs``."""
    model = OutOfPlace(profiles(learn_from, id_col, text_col, lang_col, learn_rows, top), top)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                found = grams(text)
                if not len(found) or not model.langs:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                apart = model(ranked(found, top))
                best = int(apart.argmin())
                rest = np.delete(apart, best)
                langs.append(model.langs[best])
                scores.append(float(1 - apart[best] / rest.min()) if len(rest) and rest.min() > 0 else 1.0)
            yield {"doc": batch.column(0), "lang_pred": langs, "score": scores}

    return arrow_pass(docs.select(F.col(id_col).cast("long"), text_col), "doc long, lang_pred string, score double", predict)


def digest(docs: DataFrame) -> DataFrame:
    """Rows of query op8."""
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    out = detect(docs, docs.where(~held))
    return out.withColumnRenamed("doc", "doc_id").select(
        "doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
