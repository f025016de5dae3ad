"""Benchmark decontamination: a prefix-filtered join of documents with item windows.

Words are maximal runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z are
lower-cased. A window is ``window`` consecutive words of an item; an item of
fewer words, but not none, is one window. A document word inside any occurrence
of any window is hit.

1. Items become windows and windows become shingles of up to ``shingle`` words.
   Which shingles any item has goes to the documents as a Bloom filter of a
   bounded size.
2. One pass over the documents emits each document's word count and, for each
   shingle that passes the filter, its place and the words around it, as far as a
   window can reach. This is written to shared storage once.
3. Shingles are ordered by how often the corpus has them. A window must contain
   its rarest shingle, so this one is its necessary prefix token: documents and
   windows join on it alone.
4. A pair whose window would begin before the document or end after it fails by
   the length and positional bounds; all others are compared word by word over the
   window's own length.

Defined cases: null and empty texts have no words, and are rows with zeros; an
item without words has no window; repeated items and windows count once for each
item id; rows with a null id stay in the output with zeros, since nothing
identifies them in the join; rows that share an id share their hits, places being
those of the single rows. Extra columns are not touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronmill.llm.shared import arrow_pass, ascii_lower, bit_filter, stored, without_ids

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORD.findall(ascii_lower(text)) if text else []


class WordHashes(dict):
    """64-bit hashes of words; bounded, since it starts anew when it is large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def shingle_hashes(words: list[str], width: int, known: WordHashes) -> np.ndarray:
    """A hash for each run of ``width`` words, by its first word's place."""
    n = len(words) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    out = np.full(n, width, np.uint64)
    for k in range(width):
        out = (out ^ one[k : k + n]) * MULT
        out ^= out >> np.uint64(29)
    return out


def windows(items: DataFrame, id_col: str, text_col: str, window: int, shingle: int) -> DataFrame:
    """(item, n, words, hashes): each item's distinct windows and their shingles."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = WordHashes()
        for batch in batches:
            out: dict[str, list] = {"item": [], "words": [], "n": [], "hashes": []}
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                n = min(window, len(words))
                hashes = shingle_hashes(words, min(shingle, n), known).view(np.int64)
                seen = set()
                for at in range(len(words) - n + 1):
                    own = " ".join(words[at : at + n])
                    if own not in seen:
                        seen.add(own)
                        out["item"].append(item)
                        out["words"].append(own)
                        out["n"].append(n)
                        out["hashes"].append(hashes[at : at + n - min(shingle, n) + 1])
            yield out

    rows = items.select(F.col(id_col).cast("string"), text_col).where(F.col(id_col).isNotNull())
    return arrow_pass(rows, "item string, words string, n int, hashes array<long>", cut)


def postings(
    docs: DataFrame, id_col: str, text_col: str, widths: list[int], bitmap: bytes, bits: int, window: int
) -> DataFrame:
    """(doc, n_words, posts): shingles that an item may have, with the words around."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    mask = np.uint64((1 << bits) - 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known = WordHashes()
        filter_ = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            out: dict[str, list] = {"doc": batch.column(0), "n_words": [], "posts": []}
            for text in batch.column(1).to_pylist():
                words = words_of(text)
                posts = []
                for width in widths:
                    hashes = shingle_hashes(words, width, known)
                    low = hashes & mask
                    hit = (filter_[low >> np.uint64(3)] >> (low & np.uint64(7)).astype(np.uint8)) & 1
                    for at in np.flatnonzero(hit).tolist():
                        first = max(0, at + width - window)
                        posts.append(
                            {
                                "h": int(hashes[at].view(np.int64)),
                                "at": at,
                                "first": first,
                                "around": " ".join(words[first : at + window]),
                            }
                        )
                out["n_words"].append(len(words))
                out["posts"].append(posts)
            yield out

    return arrow_pass(
        docs.select(F.col(id_col).cast("long"), text_col),
        "doc long, n_words long, posts array<struct<h:long,at:int,first:int,around:string>>",
        scan,
    )


def occurrences(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    shingle: int = 3,
    bits: int = 26,
) -> tuple[DataFrame, DataFrame]:
    """(doc, n_words) of all documents, and (doc, item, start, n) of each occurrence."""
    wins = stored(windows(items, item_id, item_text, window, shingle), "item-windows")
    shingles = wins.select(F.explode("hashes").alias("h")).distinct()
    widths = sorted({min(shingle, r.n) for r in wins.select("n").distinct().collect()})  # window values at most
    bitmap = bit_filter(shingles.select(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)).alias("place")), bits)
    found = stored(postings(docs, id_col, text_col, widths, bitmap, bits, window), "shingle-postings")
    posts = found.where("doc IS NOT NULL AND size(posts) > 0").select("doc", F.explode("posts").alias("p"))
    posts = posts.select("doc", "p.h", "p.at", "p.first", "p.around")

    rarity = found.select(F.explode("posts.h").alias("h")).groupBy("h").agg(F.count("*").alias("times"))
    each = wins.select("item", "words", "n", F.posexplode("hashes").alias("offset", "h"))
    # A window with a shingle that no document has is impossible: that one is its
    # rarest and meets no posting.
    prefix = (
        each.join(rarity, "h", "left")
        .withColumn("times", F.coalesce("times", F.lit(0)))
        .groupBy("item", "words", "n")
        .agg(F.min_by(F.struct("h", "offset"), F.struct("times", "h", "offset")).alias("p"))
        .select("item", "words", "n", "p.h", "p.offset")
    )
    pairs = posts.join(prefix, "h").withColumn("start", F.col("at") - F.col("offset"))
    bounded = pairs.where("start >= first")
    have = F.split("around", " ")
    same = F.array_join(F.slice(have, F.col("start") - F.col("first") + 1, F.col("n")), " ") == F.col("words")
    return found.select("doc", "n_words"), bounded.where(same).select("doc", "item", "start", "n")


def hits(found: DataFrame) -> DataFrame:
    """Per document with occurrences: its hit words, and its items as sorted strings."""
    merged = (
        found.select("doc", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("w"))
        .distinct()
        .groupBy("doc")
        .agg(F.count("*").alias("n_hit"))
    )
    items = found.groupBy("doc").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return merged.join(items, "doc")


def report(docs: DataFrame, items: DataFrame, **columns) -> DataFrame:
    """One row per document: n_words, n_hit, items, contaminated."""
    every, found = occurrences(docs, items, **columns)
    return every.join(hits(found), "doc", "left").select(
        "doc",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **columns) -> DataFrame:
    """``docs`` without the rows that hold a window of an item; nothing else changes."""
    _, found = occurrences(docs, items, id_col=id_col, **columns)
    return without_ids(docs, id_col, found.select("doc"))


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Rows of query op5."""
    return report(docs, items).select(
        F.col("doc").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )
