"""Quality classifier: random Fourier features, ridge normal equations, isotonic scores.

1. One Arrow pass turns each whole text into ``len(FEATURES)`` statistics, which
   are written to shared storage. Labels join these small rows, not the texts.
2. Standardised statistics ``x`` become ``sqrt(2 / D) cos(W x + b)``, whose inner
   products approximate a Gaussian kernel. Each partition sums its rows' normal
   equations for every fold; the sums meet by (fold, matrix row), so no task holds
   more than it was dealt, and the driver gets ``folds`` matrices of fixed size.
3. A ridge model of all rows scores; models that leave one fold out score that
   fold, and isotonic regression over the histogram of these scores maps scores to
   probabilities of label 1.

All labelled rows outside the held-out part are used; there is no sample.

Defined cases: null and empty texts have statistics of zero and get the score of
those; without any usable label every score is 0.5; several labels of one id count
as their largest; null labels are left out; rows with a null id are scored like
others, and are never learned from. Extra columns are not touched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronmill.llm.shared import arrow_pass, stored, without_ids

FEATURES = (
    "log_bytes", "upper", "lower", "digit", "space", "bang", "stop", "comma", "quote", "symbol", "wide",
    "log_words", "word_len", "word_len_spread", "long_words", "distinct_words", "top_word", "repeats",
    "function_words", "capital_words", "log_lines", "distinct_lines", "line_len", "ended_lines",
)

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = frozenset(
    """the of and to in is that it was for on are as with be this by from at or an have not
    der die das und ist von zu den mit im ein eine nicht auf für dem des sich auch als
    le la les et est dans un une des du pour que qui sur pas plus au avec ce par
    el los las y en de que por con para una su se del no es al lo como""".split()
)
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t\n\r\x0b\x0c",
    "bang": b"!?",
    "stop": b".;:",
    "comma": b",",
    "quote": b"\"'()-",
    "symbol": b"#$%&*+/<=>@[\\]^_`{|}~",
    "wide": bytes(range(0xC0, 0x100)),
}
_MASKS = np.array([[b in members for b in range(256)] for members in _CLASSES.values()], np.float64)


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text, each of moderate size."""
    out = np.zeros(len(FEATURES))
    if not text:
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    out[0] = np.log1p(len(raw))
    out[1:11] = _MASKS @ np.bincount(raw, minlength=256) / len(text)
    words = text.split()
    n = len(words)
    out[11] = np.log1p(n)
    if n:
        sizes = np.fromiter(map(len, words), np.float64, n)
        counts = Counter(words)
        out[12] = min(sizes.mean(), 50)
        out[13] = min(sizes.std(), 50)
        out[14] = (sizes > 20).mean()
        out[15] = len(counts) / n**0.8
        out[16] = max(counts.values()) / n
        out[17] = sum(map(str.__eq__, words, words[1:])) / n
        out[18] = sum(c for w, c in counts.items() if w.lower() in FUNCTION_WORDS) / n
        out[19] = sum(c for w, c in counts.items() if w.isupper() and len(w) > 1) / n
    lines = text.split("\n")
    out[20] = np.log1p(len(lines))
    out[21] = len(set(lines)) / len(lines)
    out[22] = np.log1p(len(text) / len(lines))
    out[23] = sum(line.endswith((".", "!", "?")) for line in lines) / len(lines)
    return out


def held_out(id_col: str, modulus: int, rest: int) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == rest


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, x): the statistics of every text."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            yield {"doc": batch.column(0), "x": [statistics(t) for t in batch.column(1).to_pylist()]}

    return arrow_pass(docs.select(F.col(id_col).cast("long"), text_col), "doc long, x array<double>", scan)


@dataclass
class Kernel:
    """Random Fourier features of standardised statistics."""

    mean: np.ndarray
    spread: np.ndarray
    width: int = 256
    seed: int = 7

    def __call__(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        p = x.shape[1]
        w = rng.standard_normal((p, self.width)) / np.sqrt(p)
        b = rng.uniform(0, 2 * np.pi, self.width)
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.c_[np.sqrt(2 / self.width) * np.cos(z @ w + b), z / np.sqrt(p), np.ones(len(x))]


def rows_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    values = batch.column(column)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def moments(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Mean and spread of each statistic over the labelled rows."""
    found = labelled.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.avg("v"), F.stddev_pop("v"))
    rows = sorted(found.collect())  # one for each statistic
    if not rows:
        return None
    table = np.array([[m, s] for _, m, s in rows])
    return table[:, 0], np.maximum(table[:, 1], 1e-6)


def normal_equations(labelled: DataFrame, kernel: Kernel, folds: int) -> np.ndarray:
    """For each fold the matrix of sums of [z y]' [z y]."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total = None
        for batch in batches:
            if not len(batch):
                continue
            z = np.c_[kernel(rows_of(batch, "x")), batch.column("y").to_numpy()]
            of = batch.column("fold").to_numpy()
            if total is None:
                total = np.zeros((folds, z.shape[1], z.shape[1]))
            for k in range(folds):
                part = z[of == k]
                total[k] += part.T @ part
        if total is not None:
            at = np.indices(total.shape[:2]).reshape(2, -1)
            yield {"fold": at[0], "i": at[1], "row": [total[a, b].tobytes() for a, b in at.T]}

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for k, i, row in zip(*(c.to_pylist() for c in batch.columns)):
                total[k, i] = total.get((k, i), 0) + np.frombuffer(row)
        if total:
            yield {"fold": [k for k, _ in total], "i": [i for _, i in total], "row": [r.tobytes() for r in total.values()]}

    schema = "fold int, i int, row binary"
    parts = arrow_pass(labelled, schema, sums).repartition("fold", "i")
    rows = arrow_pass(parts, schema, added).collect()  # folds x width of a fixed size
    out = np.zeros((folds, *[max(r.i for r in rows) + 1] * 2))
    for r in rows:
        out[r.fold, r.i] = np.frombuffer(r.row)
    return out


def ridge(sums: np.ndarray, penalty: float) -> np.ndarray:
    a, y = sums[:-1, :-1], sums[:-1, -1]
    return np.linalg.solve(a + penalty * np.eye(len(a)), y)


def isotonic(at: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: knots of the best rising function."""
    blocks: list[list[float]] = []
    for x, y, w in zip(at, label, weight):
        blocks.append([x * w, y * w, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


@dataclass
class Scorer:
    kernel: Kernel
    weights: np.ndarray
    knots: tuple[np.ndarray, np.ndarray]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.kernel(x) @ self.weights, *self.knots), 0, 1)


def fit(labelled: DataFrame, folds: int = 5, penalty: float = 0.3) -> Scorer | None:
    """A model of the rows (doc, x, y); None without rows."""
    labelled = labelled.withColumn("fold", (F.crc32(F.concat(F.lit("fold"), F.col("doc")).cast("binary")) % folds).cast("int"))
    found = moments(labelled)
    if found is None:
        return None
    kernel = Kernel(*found)
    sums = normal_equations(labelled.select("x", "y", "fold"), kernel, folds)
    left_out = np.array([ridge(sums.sum(0) - sums[k], penalty) for k in range(folds)])
    bins = 1000

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            s = np.einsum("ij,ij->i", kernel(rows_of(batch, "x")), left_out[batch.column("fold").to_numpy()])
            yield {"bin": np.clip(((s + 0.5) / 2 * bins).astype(int), 0, bins - 1), "y": batch.column("y")}

    counts = (
        arrow_pass(labelled.select("x", "y", "fold"), "bin int, y double", scored)
        .groupBy("bin")
        .agg(F.avg("y"), F.count("*"))
        .collect()
    )  # as many rows as bins
    at, label, weight = np.array(sorted(map(tuple, counts)), float).T
    return Scorer(kernel, ridge(sums.sum(0), penalty), isotonic((at + 0.5) / bins * 2 - 0.5, label, weight))


def judged(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    modulus: int = 4,
    rest: int = 2,
    threshold: float = 0.7,
) -> tuple[DataFrame, bool]:
    """(doc, held_out, score, predicted) of every row of ``docs``, and whether there were labels to learn from."""
    rows = stored(measured(docs, id_col, text_col), "quality-statistics")
    known = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
        .groupBy(F.col(id_col).cast("long").alias("doc"))
        .agg(F.max(label_col).cast("double").alias("y"))
    )
    learn = stored(rows.where(~held_out("doc", modulus, rest)).join(known, "doc"), "quality-labelled")
    scorer = fit(learn)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if len(batch):
                s = scorer(rows_of(batch, "x")) if scorer else np.full(len(batch), 0.5)
                yield {"doc": batch.column("doc"), "score": s}

    out = arrow_pass(rows, "doc long, score double", score)
    out = out.select(
        "doc",
        F.coalesce(held_out("doc", modulus, rest), F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )
    return out, scorer is not None


def quality_scores(docs: DataFrame, labels: DataFrame, *options, **named) -> DataFrame:
    """(doc, held_out, score, predicted) of every row of ``docs``."""
    return judged(docs, labels, *options, **named)[0]


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose predicted label is 0; all of them if no label can be learned from."""
    found, learned = judged(docs, labels, id_col, text_col)
    return without_ids(docs, id_col, found.where("predicted = 0").select("doc")) if learned else docs


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of query op10."""
    return quality_scores(docs, labels).withColumnRenamed("doc", "doc_id")
