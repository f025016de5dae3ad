"""Line dedup: two Bloom filters, exact confirmation of suspects, first occurrence stays.

A line's key is the line without ASCII white space at both ends and with A-Z in
lower case. Keys of at least ``min_chars`` code points that at least two
documents hold lose all their lines except in the smallest id.

1. Every task hashes its documents' distinct keys to bits and sends, for each
   segment of the filter, the bits it saw once and the bits it saw more often.
   The segments merge to one pair of Bloom filters: bits seen at least once, and
   bits seen at least twice. A key that two documents hold has all its bits in
   the second, so only that one is kept. Its size is a parameter, so what is
   broadcast is bounded; a full filter costs rows in the next step, not results.
2. Keys that pass the second filter are suspects: only they are shuffled, grouped
   by the whole key, and confirmed when their smallest and largest ids differ.
3. Confirmed keys go back to the later documents that hold them. The join on the
   key is a plain sort-merge join, so adaptive execution splits hot keys.

Defined cases: a null text is one empty line; an empty line has a key shorter
than any positive ``min_chars``; rows with the same id count as one document;
rows whose id is null neither own a first occurrence nor lose lines. The output
has the input's columns, whatever their names, plus ``n_lines`` and ``n_dropped``
(which replace input columns of these names).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from heronmill.llm.shared import arrow_pass, ascii_lower, stored

EDGE = " \t\n\x0b\x0c\r"
SEGMENT_BITS = 16


def line_key(line: str) -> str:
    return ascii_lower(line.strip(EDGE))


def document_keys(text: str | None, min_chars: int) -> set[str]:
    return {k for line in (text or "").split("\n") if len(k := line_key(line)) >= min_chars}


def bit_places(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two places in a filter of ``2 ** bits`` for each 64-bit hash."""
    mask = np.uint64((1 << bits) - 1)
    return np.concatenate([hashes & mask, (hashes >> np.uint64(64 - bits)) & mask])


def repeated_filter(docs: DataFrame, id_col: str, text_col: str, min_chars: int, bits: int) -> bytes:
    """The filter of keys that at least two rows hold, as ``2 ** bits / 8`` bytes."""

    def fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            found: list[int] = []
            for text in batch.column(0).to_pylist():
                found += [xxhash.xxh3_64_intdigest(k.encode()) for k in document_keys(text, min_chars)]
            if not found:
                continue
            places, seen = np.unique(bit_places(np.array(found, np.uint64), bits), return_counts=True)
            segment = (places >> np.uint64(SEGMENT_BITS)).astype(np.int64)
            low = (places & np.uint64((1 << SEGMENT_BITS) - 1)).astype("<u2")
            starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
            ends = np.r_[starts[1:], len(segment)]
            yield {
                "segment": segment[starts],
                "once": [low[a:b].tobytes() for a, b in zip(starts, ends)],
                "more": [low[a:b][seen[a:b] > 1].tobytes() for a, b in zip(starts, ends)],
            }

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        counts: dict[int, np.ndarray] = {}
        for batch in batches:
            for segment, once, more in zip(*(c.to_pylist() for c in batch.columns)):
                if segment not in counts:
                    counts[segment] = np.zeros(1 << SEGMENT_BITS, np.uint8)
                of = counts[segment]
                for part in (once, more):
                    at = np.frombuffer(part, "<u2")
                    of[at] = np.minimum(of[at] + 1, 2)
        for segment, of in counts.items():
            yield {"segment": [segment], "bitmap": [np.packbits(of > 1, bitorder="little").tobytes()]}

    parts = arrow_pass(docs.select(text_col), "segment long, once binary, more binary", fragments)
    segments = arrow_pass(parts.repartition("segment"), "segment long, bitmap binary", merged)
    size = 1 << (SEGMENT_BITS - 3)
    out = bytearray(1 << (bits - 3))
    for row in segments.toLocalIterator():  # 2 ** bits / 8 bytes at most
        out[row.segment * size : (row.segment + 1) * size] = row.bitmap
    return bytes(out)


def suspects(docs: DataFrame, id_col: str, text_col: str, min_chars: int, bits: int) -> DataFrame:
    """(doc, key) for keys that pass the filter of repeated keys."""
    twice = docs.sparkSession.sparkContext.broadcast(repeated_filter(docs, id_col, text_col, min_chars, bits))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        bitmap = np.frombuffer(twice.value, np.uint8)
        for batch in batches:
            owners: list[int] = []
            keys: list[str] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = document_keys(text, min_chars)
                owners += [doc] * len(own)
                keys += own
            if not keys:
                continue
            places = bit_places(np.array([xxhash.xxh3_64_intdigest(k.encode()) for k in keys], np.uint64), bits)
            hit = (bitmap[places >> np.uint64(3)] >> (places & np.uint64(7)).astype(np.uint8)) & 1
            keep = np.flatnonzero(hit[: len(keys)] & hit[len(keys) :])
            yield {"doc": [owners[i] for i in keep], "key": [keys[i] for i in keep]}

    return arrow_pass(
        docs.select(F.col(id_col).cast("long"), text_col).where(F.col(id_col).isNotNull()), "doc long, key string", passing
    )


def drops(docs: DataFrame, id_col: str, text_col: str, min_chars: int, bits: int) -> DataFrame:
    """(doc, keys): hashes of the keys that each later document loses."""
    suspect = stored(suspects(docs, id_col, text_col, min_chars, bits), "line-suspects")
    confirmed = (
        suspect.groupBy("key")
        .agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
        .where("first < last")
        .select("key", "first")
    )
    # Stored, so that the join below has shuffles of its own, which can be split.
    confirmed = stored(confirmed, "line-confirmed")
    later = suspect.join(confirmed, "key").where("doc > first")
    return later.groupBy("doc").agg(F.collect_set("key").alias("keys"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, bits: int = 26
) -> DataFrame:
    """``docs`` with repeated lines taken out of the text, ``n_lines`` and ``n_dropped``."""
    lost = drops(docs, id_col, text_col, min_chars, bits)
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    at = {c: i for i, c in enumerate(names)}
    # Positional names keep clashes with the input's columns out of the join.
    left = docs.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)))
    both = left.join(
        lost.select(F.col("doc").alias("_doc"), F.col("keys").alias("_keys")),
        F.col(f"_{at[id_col]}").cast("long") == F.col("_doc"),
        "left",
    )
    kind = StructType([*left.schema.fields]).add("_lines", "long").add("_dropped", "long")
    text_at = at[text_col]
    width = len(names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            keys = batch.column(width).to_pylist()
            for text, gone in zip(batch.column(text_at).to_pylist(), keys):
                lines = (text or "").split("\n")
                n_lines.append(len(lines))
                if gone:
                    gone = set(gone)
                    kept = [line for line in lines if line_key(line) not in gone]
                    n_dropped.append(len(lines) - len(kept))
                    texts.append("\n".join(kept))
                else:
                    n_dropped.append(0)
                    texts.append(text)
            columns = [batch.column(i) for i in range(width)]
            columns[text_at] = pa.array(texts, columns[text_at].type)
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                names=[f.name for f in kind],
            )

    out = both.select(*left.columns, "_keys").mapInArrow(cut, kind)
    return out.select(
        *(F.col(f"_{i}").alias(c) for i, c in enumerate(names)),
        F.col("_lines").alias("n_lines"),
        F.col("_dropped").alias("n_dropped"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """Rows of query op7."""
    return dedup_lines(docs.select("doc_id", "text")).select(
        "doc_id",
        "n_lines",
        "n_dropped",
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )
