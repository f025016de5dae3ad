"""Target-distribution importance resampling over hashed n-grams.

Features of a text are its runs of one to three words. Counting them goes through
integers: the distinct words of a window of text get ids, a run of words is a tuple of
ids, and of every distinct tuple of the window the bytes are put together and hashed
once, from those of the tuple without its last word. The counts of a tuple, or its gain,
then go back to all places where it stands.

1. A pass over the raw and the target texts counts features by bucket: each task gives
   at most ``buckets`` numbers, whatever it reads.
2. ``buckets`` gains are the log-ratios of the smoothed shares of a bucket in both. They are the
   only data sent to tasks.
3. A second pass sums the gains of a text's features. With a Gumbel number for its id,
   the highest sums are a draw without replacement by importance weight.
4. The share that is drawn grows with the table, so ranks are given in ranges: the
   rows are dealt by ranges of their order, and a range's ranks follow those of the ranges before.

The dictionary of words holds for a window of text in a task, not for the whole corpus: one for all texts
would move every word and every tuple through a shuffle.

Defined cases: null texts have no words, no features and a weight of 0; a null id is hashed as
an empty string and comes after all others in ties; rows that repeat an id each get a row, and rows that agree in
score and id are ranked by weight and number of features. Without texts of at least ``least_words`` words nothing
is drawn; an empty table gives an empty one; without target texts all gains are those of a uniform
target. Extra columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heronmill.llm.shared import arrow_pass, stored

#: Bytes of words: digits, letters and all bytes of characters beyond ASCII.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[ord("0") : ord("9") + 1] = WORD_BYTE[ord("a") : ord("z") + 1] = WORD_BYTE[ord("A") : ord("Z") + 1] = True
WORD_BYTE[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Bytes of text whose words share a dictionary; a longer word makes a longer window.
WINDOW = 1 << 22


class Words(NamedTuple):
    """Words of a window, in order; the first ``old`` of them were counted in the window before."""

    doc: np.ndarray
    ids: np.ndarray
    distinct: list[bytes]
    old: int


def windows(texts: pa.Array, most: int = WINDOW, longest: int = 3) -> Iterator[Words]:
    """The words of all texts; in front of those of a text that goes on stand its last words before."""
    texts = pc.fill_null(texts, "").cast(pa.large_binary())
    places = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at, last = int(places[0]), int(places[-1])
    carried: list[bytes] = []
    while at < last:
        end = min(last, at + most)
        if end < last:
            end = _word_cut(data, at, end, last)
        head = b"".join(w + b" " for w in carried)
        own = np.r_[np.frombuffer(head, np.uint8), data[at:end]]
        word = WORD_BYTE[own]
        edge = np.zeros(len(own) + 1, bool)
        edge[places[(places > at) & (places <= end)] - at + len(head)] = True
        starts = np.flatnonzero(word & (edge[:-1] | ~np.r_[False, word[:-1]]))
        ends = np.flatnonzero(word & (edge[1:] | ~np.r_[word[1:], False])) + 1
        inside = int(np.searchsorted(places, end, "right")) - 1  # the text that goes on behind the end, if one does
        goes_on = int(places[inside]) < end < last
        if len(starts):
            offsets = np.r_[0, np.cumsum(ends - starts)].astype(np.int64)
            coded = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(LOWER[own[word]])]
            ).dictionary_encode()
            doc = np.searchsorted(places, np.maximum(starts - len(head), 0) + at, "right") - 1
            ids, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
            yield Words(doc, ids, distinct, len(carried))
            before = [distinct[ids[i]] for i in range(max(0, len(ids) - longest + 1), len(ids)) if doc[i] == inside]
            carried = before if goes_on else []
        at = end


def _word_cut(data: np.ndarray, begin: int, end: int, last: int) -> int:
    """A place at or near ``end`` that is not inside a word: before it, or else behind the word."""
    step = 1 << 12
    at = end
    while at > begin:
        low = max(begin, at - step)
        gaps = np.flatnonzero(~WORD_BYTE[data[low:at]])
        if len(gaps):
            return low + int(gaps[-1]) + 1
        at = low
    at = end
    while at < last:
        gaps = np.flatnonzero(~WORD_BYTE[data[at : at + step]])
        if len(gaps):
            return at + int(gaps[0])
        at += step
    return last


#: Longer words are hashed one by one.
SHORT = 64
_STEP = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _STEP = np.where(_STEP & 1, (_STEP >> 1) ^ np.uint32(0xEDB88320), _STEP >> 1)


class Hashing:
    """crc32 of runs of the words of a window."""

    def __init__(self, distinct: list[bytes]):
        self.words = distinct
        self.size = np.array([len(w) for w in distinct])
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(distinct), np.uint8)

    def longer(self, heads: np.ndarray, tails: np.ndarray) -> np.ndarray:
        """Hashes of runs, from those of the runs without the last word, and that word: its bytes follow a space."""
        state = ~heads
        state = _STEP[(state ^ 32) & 255] ^ (state >> 8)
        short = np.minimum(self.size[tails], SHORT + 1).astype(np.uint8)
        order = np.argsort(short, kind="stable")[::-1]
        state, place, counts = state[order], self.at[tails[order]], np.bincount(short, minlength=SHORT + 2)
        more = len(order) - np.cumsum(counts)  # how many are longer than each size
        for j in range(SHORT):
            if not (n := int(more[j])):
                break
            own = state[:n]
            state[:n] = _STEP[(own ^ self.bytes[place[:n] + j]) & 255] ^ (own >> 8)
        out = np.empty_like(state)
        out[order] = ~state
        for i in np.flatnonzero(short > SHORT).tolist():
            out[i] = crc32(b" " + self.words[tails[i]], int(heads[i]))
        return out


def numbered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, and the number of each key among them."""
    order = np.argsort(keys)
    own = keys[order]
    new = np.ones(len(own), bool)
    np.not_equal(own[1:], own[:-1], out=new[1:])
    places = np.empty(len(own), np.int64)
    places[order] = np.cumsum(new) - 1
    return own[new], places


def features(words: Words, buckets: int, longest: int = 3) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of a run: the documents of the new runs, and their buckets.

    A run's tuple is the number of the run without its last word, and the id of that word.
    """
    size = len(words.distinct)
    hashing = Hashing(words.distinct)
    hashed = np.array([crc32(w) for w in words.distinct], np.uint32)
    tuples = words.ids
    yield words.doc[words.old :], (hashed % buckets)[tuples[words.old :]]
    for n in range(2, longest + 1):
        if len(words.ids) < n:
            return
        # Runs across documents are among the tuples and left out of what is given.
        distinct, tuples = numbered(tuples[:-1] * size + words.ids[n - 1 :])
        heads, tails = np.divmod(distinct, size)
        hashed = hashing.longer(hashed[heads], tails)
        own = words.doc[n - 1 :] == words.doc[: len(words.doc) - n + 1]
        own[: max(0, words.old - n + 1)] = False
        yield words.doc[n - 1 :][own], (hashed % buckets)[tuples[own]]


def bucket_counts(docs: DataFrame, text_col: str, buckets: int) -> DataFrame:
    """(bucket, n) of all features of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for words in windows(batch.column(0)):
                for _, bucket in features(words, buckets):
                    n += np.bincount(bucket, minlength=buckets)
        held = np.flatnonzero(n)
        yield {"bucket": held.astype(np.int32), "n": n[held]}

    return arrow_pass(docs.select(text_col), "bucket int, n long", count).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """``floor(1000 * ln)`` of the ratio of smoothed shares, by bucket; ``buckets`` rows come to the driver."""
    s, t = np.zeros((2, buckets))
    for docs, out in ((raw, s), (target, t)):
        for r in bucket_counts(docs, text_col, buckets).collect():
            out[r.bucket] = r.n
    ratio = ((t + 1) * (s.sum() + buckets)) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def gumbel(id_col: str, seed: int) -> Column:
    """``floor(-1000 * ln(-ln u))`` for a number u in (0, 1) that a hash of the id gives."""
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), ident), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def weighted(docs: DataFrame, own: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """(doc, n_words, n_features, weight) of every row."""
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            size = len(batch)
            n, weight = np.zeros((2, size), np.int64)
            first = np.zeros(size, np.int64)
            for words in windows(batch.column(1)):
                for k, (doc, bucket) in enumerate(features(words, len(own))):
                    n += np.bincount(doc, minlength=size)
                    # Whole numbers far below 2 ** 53 are exact here.
                    weight += np.bincount(doc, own[bucket], size).astype(np.int64)
                    if not k:
                        first += np.bincount(doc, minlength=size)
            yield {"doc": batch.column(0), "n_words": first, "n_features": n, "weight": weight}

    return arrow_pass(docs.select(id_col, text_col), f"doc {kind}, n_words long, n_features long, weight long", score)


def ranked(rows: DataFrame, order: list[Column], most: int) -> DataFrame:
    """``rows`` with ``rank``, 1 to ``most`` in this order and null beyond; no task sees all rows."""
    spark = rows.sparkSession
    names = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        own, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            places = np.arange(at, at + len(batch))
            yield {c: batch.column(i) for i, c in enumerate(names)} | {"_range": np.full(len(batch), own), "_at": places}
            at += len(batch)

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
    schema = StructType(rows.schema.fields).add("_range", "long").add("_at", "long")
    dealt = stored(arrow_pass(dealt, schema, number), "importance-ranges")
    # One row for each range.
    sizes = sorted((r[0], r[1]) for r in dealt.groupBy("_range").count().collect())
    before = np.cumsum([0, *(n for _, n in sizes)]).tolist()
    firsts = spark.createDataFrame([(k, b) for (k, _), b in zip(sizes, before)], "_own long, _before long")
    place = F.col("_before") + F.col("_at") + 1
    return dealt.join(F.broadcast(firsts), F.col("_range") == F.col("_own")).select(
        *names, F.when(place <= most, place).alias("rank")
    )


def resampled(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 10_000,
    percent: int = 5,
    least_words: int = 20,
    seed: int = 42,
) -> DataFrame:
    """(doc, n_words, n_features, weight, score, rank) of every row of ``docs``; ``rank`` is null where it was not drawn."""
    own = gains(docs, target, text_col, buckets)
    rows = weighted(docs, own, id_col, text_col).withColumn("score", F.col("weight") + gumbel("doc", seed))
    rows = stored(rows, "importance-weights")
    some = F.col("n_words") >= least_words
    most = rows.where(some).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc"), F.desc("weight"), F.desc("n_features")]
    rest = rows.where(~some).withColumn("rank", F.lit(None).cast("long"))
    return ranked(rows.where(some), order, most).unionByName(rest)


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; rows that share an id go together."""
    picked = resampled(docs, target, id_col, **options).where("rank IS NOT NULL").select(F.col("doc").alias("_drawn"))
    return docs.join(picked.distinct(), F.col(f"`{id_col}`").eqNullSafe(F.col("_drawn")), "left_semi")


def digest(docs: DataFrame, target: DataFrame) -> DataFrame:
    """Rows of query op11."""
    return resampled(docs, target).select(F.col("doc").alias("doc_id"), "n_features", "weight", "score", "rank")
