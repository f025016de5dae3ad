"""Suffix-array dedup over a logarithmic family of indexes.

A byte goes when a string of ``length`` bytes that covers it also starts earlier: in
a document with a smaller id, or earlier in the same one.

1. Whole copies of a text stay out of the index; they lose all bytes if they have
   ``length`` at least, since the first copy holds every string of theirs.
2. Each string of ``length`` bytes has one anchor: the leftmost lowest hash among the
   runs of ``length // 3`` bytes in it. Equal strings have theirs at the same offset,
   so it is enough to index the suffixes that begin at anchors, about one byte in
   thirty-four. A batch becomes such a sparse suffix array, sorted by the hash of the
   suffix's first ``length // 3`` bytes (key) and by the hash of all bytes that the
   anchor's strings reach (context). Only first entries of a key and context stay.
3. A new batch is merge-scanned with every level of the family. An entry whose key and
   context stand before repeats as a whole; its 128 bits of hash settle this. Where a
   key has several contexts, their first entries' bytes are read again from the
   documents and compared byte by byte: a string is a repeat if an equal one has a
   smaller (doc, start).
4. The batch joins the family as its lowest level; two levels of about the same size
   merge into one of double size, so a family over n batches has log n levels.

Batches are ranges of ids in rising order, so what is earlier is in the same batch
or in a level. Keys with more than ``hot`` suffixes are not gathered: a finer index of
blocks of their strings settles what repeats as a whole, and the strings of other blocks
are sorted by a 128-bit hash and read as a stream, so that no group is ever held.

Defined cases: null and empty texts have no bytes; rows that share an id and a text
count as one document; a row with a null id loses nothing and is not indexed;
different texts under one id are compared by place as if they were one document.
Every input row gives one output row. Extra columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heronmill.llm.shared import arrow_pass, bit_filter, filter_bits, stored, whole_groups
from heronmill.sources.storage import Scratch

PIECE = 1 << 19
PLACE_BITS = 20
_RNG = np.random.default_rng(5)
_LETTERS = _RNG.integers(0, 2**63, (2, 256), np.uint64)
_BASES = tuple(int(x) | 1 for x in _RNG.integers(2**61, 2**62, 2))


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(np.r_[np.uint64(1), np.full(n, base, np.uint64)])


class Rolling:
    """64-bit hashes of runs of bytes, from sums of powers of an odd base."""

    def __init__(self, which: int = 0):
        self.letters = _LETTERS[which]
        self.base = _BASES[which]
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.empty(0, np.uint64)

    def sums(self, raw: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(raw):
            self.up, self.down = powers(self.base, 2 * len(raw)), powers(self.inverse, 2 * len(raw))
        return np.r_[np.uint64(0), np.cumsum(self.letters[raw] * self.up[: len(raw)], dtype=np.uint64)]

    def __call__(self, raw: np.ndarray, length: int) -> np.ndarray:
        """Of all runs of a length."""
        sums = self.sums(raw)
        return mixed((sums[length:] - sums[:-length]) * self.down[: len(raw) - length + 1])

    def spans(self, raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of some runs of any lengths."""
        sums = self.sums(raw)
        return mixed((sums[end] - sums[begin]) * self.down[begin] + (end - begin).astype(np.uint64))


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_least(values: np.ndarray, span: int) -> np.ndarray:
    """Minima of all runs of ``span`` values, from running minima of blocks in both directions."""
    padded = np.full(-(-len(values) // span) * span, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    n = len(values) - span + 1
    return np.minimum(back[:n], ahead[span - 1 : span - 1 + n])


class Anchors:
    """The anchors of texts, with the bytes that an anchor's strings reach as its context."""

    def __init__(self, length: int):
        self.length = length
        self.suffix, self.whole = Rolling(0), Rolling(1)

    def __call__(self, raw: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(key, context hash, first string, last string, bytes of the first before its anchor), by pieces of a text."""
        size = self.length // 3
        span = self.length - size + 1
        low = np.uint64((1 << PLACE_BITS) - 1)
        for begin in range(0, len(raw) - self.length + 1, PIECE):
            part = raw[begin : begin + PIECE + self.length - 1]
            h = self.suffix(part, size)
            # The place in the low bits finds the anchor and breaks ties to the left.
            at = (sliding_least((h & ~low) | np.arange(len(h), dtype=np.uint64), span) & low).astype(np.int64)
            first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            last = np.r_[first[1:] - 1, len(at) - 1]
            context = self.whole.spans(part, first, last + self.length)
            yield h[at[first]].view(np.int64), context.view(np.int64), first + begin, last + begin, at[first] - first


def index_entries(docs: DataFrame, length: int, but: IdFilter | None = None) -> DataFrame:
    """(key, context, doc, lo, hi): the anchors of a batch and the strings that they stand for.

    Rows whose id passes the filter ``but`` are left out.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        find = Anchors(length)
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            ids = batch.column(0).to_numpy()
            some = range(len(ids)) if but is None else np.flatnonzero(~but.passes(ids)).tolist()
            for i in some:
                for key, context, lo, hi, _ in find(np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8)):
                    parts.append((key, context, np.full(len(key), ids[i]), lo, hi))
                    held += len(key)
                if held > 100_000:
                    yield dict(zip(("key", "context", "doc", "lo", "hi"), map(np.concatenate, zip(*parts))))
                    parts, held = [], 0
        if parts:
            yield dict(zip(("key", "context", "doc", "lo", "hi"), map(np.concatenate, zip(*parts))))

    return arrow_pass(docs.select("doc", "text"), ENTRY, scan)


ENTRY = "key long, context long, doc long, lo int, hi int"
REPEAT, EDGE, FIRST = 0, 1, 2


def identity(key: np.ndarray, context: np.ndarray, doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """A hash of one anchor of one document."""
    u = np.uint64
    h = key.view(u) ^ mixed(context.view(u) + doc.astype(np.int64).view(u) * u(_BASES[0])) ^ (lo.astype(u) * u(_BASES[1]))
    return mixed(h)


def merge_scan(entries: DataFrame, from_doc: int, bits: int, keep: bool) -> DataFrame:
    """Entries of levels and a batch side by side, as (kind, entry, place) rows.

    Sorted by key, context, doc and place, an entry whose key and context stand
    before is a repeat as a whole: REPEAT. Where a key has several contexts, the
    first entries of each may share strings: EDGE. The first entries of a batch
    are its suffix array: FIRST. One entry is held over from batch to batch.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("key", "context", "doc", "lo", "hi")
        head = leader = None  # the first entry of the key, and of the context
        shown = False
        for batch in batches:
            if not len(batch):
                continue
            c = {n: batch.column(n).to_numpy() for n in names}
            if head is not None:  # the two entries held over come first
                c = {n: np.r_[head[n], leader[n], c[n]].astype(c[n].dtype) for n in names}
            n = len(c["key"])
            new_key = np.r_[True, c["key"][1:] != c["key"][:-1]]
            new_context = new_key | np.r_[True, c["context"][1:] != c["context"][:-1]]
            at = np.arange(n)
            key_at = np.maximum.accumulate(np.where(new_key, at, 0))
            context_at = np.maximum.accumulate(np.where(new_context, at, 0))
            own = at >= (2 if head is not None else 0)
            other = (c["doc"] != c["doc"][context_at]) | (c["lo"] != c["lo"][context_at])
            again = own & ~new_context & other & (c["doc"] >= from_doc)
            first = own & new_context
            later = first & ~new_key
            heads = np.unique(key_at[later])
            if head is not None and len(heads) and heads[0] == 0 and shown:
                heads = heads[1:]
            edge = np.union1d(np.flatnonzero(later), heads)
            fresh = np.flatnonzero(first & (c["doc"] >= from_doc)) if keep else np.empty(0, np.int64)
            rows = np.concatenate([np.flatnonzero(again), edge, fresh])
            kind = np.repeat([REPEAT, EDGE, FIRST], [again.sum(), len(edge), len(fresh)])
            if len(rows):
                out = {k: v[rows] for k, v in c.items()}
                place = identity(out["key"], out["context"], out["doc"], out["lo"]) & np.uint64((1 << bits) - 1)
                yield {"kind": kind, "place": place.astype(np.int64)} | out
            last = key_at[-1]
            shown = bool(later[last + 1 :].any() or (last == 0 and head is not None and shown))
            head = {k: v[last : last + 1] for k, v in c.items()}
            leader = {k: v[context_at[-1] : context_at[-1] + 1] for k, v in c.items()}

    dealt = entries.repartition("key").sortWithinPartitions("key", "context", "doc", "lo")
    return arrow_pass(dealt, f"kind int, place long, {ENTRY}", scan)


def surroundings(docs: DataFrame, length: int, wanted: bytes, owners: bytes, bits: int) -> DataFrame:
    """(key, doc, at, ahead, around): the contexts' bytes of the anchors in the filter.

    ``at`` is the first string's place, ``ahead`` its bytes before the anchor.
    """
    sent = docs.sparkSession.sparkContext.broadcast((wanted, owners))
    mask = (1 << bits) - 1

    def hit(bitmap: np.ndarray, place: np.ndarray) -> np.ndarray:
        return np.flatnonzero((bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        find = Anchors(length)
        bitmap, known = (np.frombuffer(b, np.uint8) for b in sent.value)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            out: dict[str, list] = {"key": [], "doc": [], "at": [], "ahead": [], "around": []}
            for i in hit(known, ids & mask).tolist():
                raw = np.frombuffer(batch.column(1)[i].as_buffer(), np.uint8)
                for key, context, lo, hi, ahead in find(raw):
                    doc = np.full(len(key), ids[i])
                    some = hit(bitmap, (identity(key, context, doc, lo) & np.uint64(mask)).astype(np.int64))
                    out["key"] += key[some].tolist()
                    out["doc"] += doc[some].tolist()
                    out["at"] += lo[some].tolist()
                    out["ahead"] += ahead[some].tolist()
                    out["around"] += [raw[a : b + length].tobytes() for a, b in zip(lo[some], hi[some])]
                if len(out["key"]) > 10_000:
                    yield out
                    out = {"key": [], "doc": [], "at": [], "ahead": [], "around": []}
            yield out

    return arrow_pass(docs.select("doc", "text"), "key long, doc long, at long, ahead int, around binary", scan)


def strings_of(table: pa.Table | pa.RecordBatch, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined bytes of all rows, and each string's row, place in the row and place in the bytes."""
    around = table.column("around").to_pylist()
    sizes = np.fromiter(map(len, around), np.int64, len(around))
    n = sizes - length + 1
    row = np.repeat(np.arange(len(around)), n)
    step = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    return np.frombuffer(b"".join(around), np.uint8), row, step, (np.cumsum(sizes) - sizes)[row] + step


def runs(doc: np.ndarray, start: np.ndarray) -> dict[str, np.ndarray]:
    """Runs of consecutive starts as (doc, lo, hi)."""
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + 1)]
    ends = np.r_[np.flatnonzero(new)[1:] - 1, len(doc) - 1]
    return {"doc": doc[new], "lo": start[new], "hi": start[ends]}


def repeats(around: DataFrame, length: int, from_doc: int) -> DataFrame:
    """(doc, lo, hi): runs of starts of strings that start earlier elsewhere, in new documents."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        rolling = Rolling()
        for table in whole_groups(batches, ["key"], rows=3_000):
            raw, row, step, place = strings_of(table, length)
            doc = table.column("doc").to_numpy()[row]
            start = table.column("at").to_numpy()[row] + step
            value = rolling(raw, length)[place]
            order = np.lexsort((start, doc, value))
            value, place, doc, start = value[order], place[order], doc[order], start[order]
            new = np.r_[True, value[1:] != value[:-1]]
            first = np.flatnonzero(new)[np.cumsum(new) - 1]
            later = np.flatnonzero(~new & ((doc != doc[first]) | (start != start[first])))
            windows = sliding_window_view(raw, length)
            for s in range(0, len(later), 100_000):
                some = later[s : s + 100_000]
                equal = (windows[place[some]] == windows[place[first[some]]]).all(axis=1)
                if not equal.all():  # two strings with one hash: compare each with all before it
                    for i in some[~equal]:
                        earlier = range(first[i], i)
                        equal[np.searchsorted(some, i)] = any(
                            (windows[place[j]] == windows[place[i]]).all() and (doc[j], start[j]) != (doc[i], start[i])
                            for j in earlier
                        )
                some = some[equal & (doc[some] >= from_doc)]
                if len(some):
                    yield runs(doc[some], start[some])

    dealt = around.repartition("key").sortWithinPartitions("key")
    return arrow_pass(dealt, "doc long, lo long, hi long", verify)


def finer_entries(around: DataFrame, length: int, width: int) -> DataFrame:
    """Entries of ``width`` strings at most, for keys with many: a finer index of the same form.

    Strings are told apart by how far they begin before their anchor. Those of one block share
    the bytes in their middle, all but ``width - 1`` of ``length``, whose hash is the new key.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        middle, whole = Rolling(0), Rolling(1)
        for batch in batches:
            for s in range(0, len(batch), 2000):
                part = batch.slice(s, 2000)
                around = part.column("around").to_pylist()
                sizes = np.fromiter(map(len, around), np.int64, len(around))
                raw, begin = np.frombuffer(b"".join(around), np.uint8), np.cumsum(sizes) - sizes
                ahead, at, doc = (part.column(c).to_numpy().astype(np.int64) for c in ("ahead", "at", "doc"))
                least = ahead - (sizes - length)  # of the last string
                block = [np.arange(a // width, b // width + 1) for a, b in zip(least, ahead)]
                row = np.repeat(np.arange(len(around)), list(map(len, block)))
                block = np.concatenate(block) if block else np.empty(0, np.int64)
                far = np.minimum(ahead[row], (block + 1) * width - 1)
                near = np.maximum(least[row], block * width)
                anchor = begin[row] + ahead[row]
                key = middle.spans(raw, anchor - block * width, anchor - (block + 1) * width + 1 + length)
                key = mixed(key + block.astype(np.uint64))
                context = whole.spans(raw, anchor - far, anchor - near + length)
                first = at[row] + ahead[row]
                yield {"key": key.view(np.int64), "context": context.view(np.int64), "doc": doc[row], "lo": first - far, "hi": first - near}

    return arrow_pass(around, ENTRY, scan)


def hot_repeats(around: DataFrame, length: int, from_doc: int, bits: int, scratch: Scratch, width: int = 13) -> DataFrame:
    """The same for keys of any size: ``finer_entries`` settle what repeats as a whole, single strings the rest."""
    finer = scratch.stored(merge_scan(finer_entries(around, length, width), from_doc, bits, False), "finer-scan")
    whole = finer.where(F.col("kind") == REPEAT).select("doc", F.col("lo").cast("long"), F.col("hi").cast("long"))
    edges = finer.where(F.col("kind") == EDGE).select(F.col("doc").alias("_doc"), "lo", "hi")
    last = F.col("at") + F.octet_length("around") - length
    near = around.join(edges, (F.col("doc") == F.col("_doc")) & F.col("lo").between(F.col("at"), last)).select(
        "doc",
        F.col("lo").cast("long").alias("at"),
        F.expr(f"substring(around, int(lo - at + 1), hi - lo + {length})").alias("around"),
    )
    return whole.unionByName(string_repeats(near, length, from_doc))


def string_repeats(around: DataFrame, length: int, from_doc: int) -> DataFrame:
    """The same string by string: they are sorted by a 128-bit hash and read as a stream.

    Neither a key nor a string is gathered: one row is held over from batch to batch.
    """

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        both = Rolling(0), Rolling(1)
        for batch in batches:
            for s in range(0, len(batch), 2000):
                part = batch.slice(s, 2000)
                raw, row, step, place = strings_of(part, length)
                one, two = (r(raw, length)[place].view(np.int64) for r in both)
                yield {
                    "one": one,
                    "two": two,
                    "doc": part.column("doc").to_numpy()[row],
                    "start": part.column("at").to_numpy()[row] + step,
                }

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        names = ("one", "two", "doc", "start")
        leader = None  # the first place of the string read last
        for batch in batches:
            if not len(batch):
                continue
            c = {n: batch.column(n).to_numpy() for n in names}
            if leader is not None:
                c = {n: np.r_[leader[n], c[n]] for n in names}
            new = np.r_[True, (c["one"][1:] != c["one"][:-1]) | (c["two"][1:] != c["two"][:-1])]
            first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
            rows = (c["doc"] != c["doc"][first]) | (c["start"] != c["start"][first])
            rows &= c["doc"] >= from_doc
            yield {"doc": c["doc"][rows], "start": c["start"][rows]}
            leader = {n: v[first[-1] : first[-1] + 1] for n, v in c.items()}

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            if len(batch):
                yield runs(batch.column("doc").to_numpy(), batch.column("start").to_numpy())

    every = arrow_pass(around, "one long, two long, doc long, start long", strings)
    dealt = every.repartition("one", "two").sortWithinPartitions("one", "two", "doc", "start")
    found = arrow_pass(dealt, "doc long, start long", later).repartition("doc").sortWithinPartitions("doc", "start")
    return arrow_pass(found, "doc long, lo long, hi long", joined)


class SuffixIndexFamily:
    """Levels of sparse suffix arrays over the documents added so far."""

    def __init__(self, length: int = 100, bits: int = 28, hot: int = 20_000):
        self.length, self.bits, self.hot = length, bits, hot
        self.levels: list[tuple[int, DataFrame, Scratch]] = []
        self.docs: DataFrame | None = None

    def add(self, docs: DataFrame, from_doc: int, last: bool = False, but: IdFilter | None = None, cleared: DataFrame | None = None) -> DataFrame:
        """Index (doc, text) rows, whose ids are ``from_doc`` or more and above those before.

        Rows whose id passes the filter ``but`` are indexed only if they are among ``cleared``.

        Returns the runs of repeated strings that start in them. After the ``last``
        batch no level is needed any more, so none is written.
        """
        spark = docs.sparkSession
        self.docs = docs if self.docs is None else self.docs.unionByName(docs)
        entries = index_entries(docs, self.length, but)
        if cleared is not None:
            entries = entries.unionByName(index_entries(cleared, self.length))
        for _, level, _ in self.levels:
            entries = entries.unionByName(level)
        scratch = Scratch(spark)
        found = scratch.stored(merge_scan(entries, from_doc, self.bits, not last), "suffix-scan")
        edges = found.where(F.col("kind") == EDGE)
        bits = filter_bits(edges.count(), self.bits)
        low = F.lit((1 << bits) - 1)
        wanted = bit_filter(edges.select(F.col("place").bitwiseAND(low).alias("place")), bits)
        owners = bit_filter(edges.select(F.col("doc").bitwiseAND(low).alias("place")), bits)
        around = scratch.stored(surroundings(self.docs, self.length, wanted, owners, bits), "suffix-contexts")
        hot = edges.groupBy("key").count().where(F.col("count") >= self.hot).select("key")
        hot = scratch.stored(hot, "hot-keys")
        runs_ = found.where(F.col("kind") == REPEAT).select("doc", F.col("lo").cast("long"), F.col("hi").cast("long"))
        runs_ = runs_.unionByName(repeats(around.join(hot, "key", "left_anti"), self.length, from_doc))
        if not hot.isEmpty():
            runs_ = runs_.unionByName(hot_repeats(around.join(hot, "key", "left_semi"), self.length, from_doc, self.bits, scratch))
        runs_ = stored(runs_, "suffix-repeats")
        if last:
            self.close()
        else:
            own = Scratch(spark)
            first = found.where(F.col("kind") == FIRST).select("key", "context", "doc", "lo", "hi")
            self.levels.append((1, own.stored(first, "suffix-array"), own))
            while len(self.levels) > 1 and self.levels[-1][0] >= self.levels[-2][0]:
                self.merge()
        scratch.clear()
        return runs_

    def merge(self) -> None:
        """The two lowest levels become one, sorted again by key."""
        (n, low, low_files), (m, high, high_files) = self.levels.pop(), self.levels.pop()
        own = Scratch(low.sparkSession)
        both = high.unionByName(low).repartition("key").sortWithinPartitions("key", "context", "doc", "lo")
        self.levels.append((n + m, own.stored(both, "suffix-array"), own))
        low_files.clear()
        high_files.clear()

    def close(self) -> None:
        """Delete the levels."""
        for _, _, own in self.levels:
            own.clear()
        self.levels = []


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 100, batches: int = 3, **options
) -> DataFrame:
    """(doc, n_bytes, n_removed, n_spans, kept) for every row: ``kept`` are the bytes that stay."""
    every = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(text_col, F.lit("")).alias("text"))
    digest_ = F.sha2(F.col("text").cast("binary"), 256)
    long_ = every.where(F.col("doc").isNotNull() & (F.octet_length("text") >= length))
    firsts = stored(long_.groupBy(digest_.alias("sha")).agg(F.min("doc").alias("first")), "text-firsts")
    copies = (
        long_.select("doc", digest_.alias("sha"))
        .join(firsts, "sha")
        .where("doc > first")
        .select("doc", "sha")
        .distinct()
    )
    copies = stored(copies, "text-copies")
    # Texts move only for rows that a filter of the copies' ids lets pass.
    twins = IdFilter(copies, "doc", options.get("bits", 28))
    gone = copies.select(F.col("doc").alias("_doc"), F.col("sha").alias("_sha"))
    ids = long_.select("doc")
    cuts = ids.agg(F.percentile_approx("doc", [i / batches for i in range(batches)], 10_000)).first()[0]
    found: DataFrame | None = None
    if cuts:
        edges = [None, *sorted(set(cuts[1:])), None]
        family = SuffixIndexFamily(length, **options)
        for low, high in zip(edges, edges[1:]):  # as many rounds as batches
            part = long_
            if low is not None:
                part = part.where(F.col("doc") >= low)
            if high is not None:
                part = part.where(F.col("doc") < high)
            suspects = twins.divided(part, True)
            cleared = suspects.join(gone, (F.col("doc") == F.col("_doc")) & (digest_ == F.col("_sha")), "left_anti")
            more = family.add(part, low if low is not None else -(1 << 63), high is None, twins, cleared)
            found = more if found is None else found.unionByName(more)
    schema = "doc long, n_bytes long, n_removed long, n_spans long, kept binary"

    def cut(batches_: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in (b.slice(k, 500) for b in batches_ for k in range(0, len(b), 500)):
            out: dict[str, list] = {"doc": batch.column("doc"), "n_bytes": [], "n_removed": [], "n_spans": [], "kept": []}
            for text, copy, spans in zip(
                batch.column("text"), batch.column("copy").to_pylist(), batch.column("spans").to_pylist()
            ):
                raw = np.frombuffer(text.as_buffer(), np.uint8)
                gone = np.zeros(len(raw) + 1, np.int32)
                if copy:
                    gone[0], gone[-1] = 1, -1
                elif spans:
                    at = np.array([(s["lo"], s["hi"] + length) for s in spans])
                    np.add.at(gone, at[:, 0], 1)
                    np.add.at(gone, at[:, 1], -1)
                off = np.cumsum(gone[:-1]) > 0
                out["n_bytes"].append(len(raw))
                out["n_removed"].append(int(off.sum()))
                out["n_spans"].append(int((off & ~np.r_[False, off[:-1]]).sum()))
                out["kept"].append(raw[~off].tobytes())
            yield out

    if found is None:
        rows = every.select("doc", "text", F.lit(False).alias("copy"), F.array().cast("array<struct<lo:long,hi:long>>").alias("spans"))
        return arrow_pass(rows, schema, cut)
    lost = found.select("doc", F.struct("lo", "hi").alias("span"), F.lit(None).cast("string").alias("sha"))
    lost = lost.unionByName(copies.select("doc", F.lit(None).cast(lost.schema["span"].dataType).alias("span"), "sha"))
    lost = lost.groupBy(F.col("doc").alias("_doc")).agg(F.collect_set("span").alias("spans"), F.collect_set("sha").alias("shas"))
    lost = stored(lost, "suffix-spans")
    losing = IdFilter(lost, "_doc", options.get("bits", 28))
    rows = losing.divided(every, True).join(lost, F.col("doc") == F.col("_doc"), "left")
    rows = rows.select("doc", "text", F.coalesce(F.array_contains("shas", digest_), F.lit(False)).alias("copy"), "spans")
    whole = losing.divided(every, False).select(
        "doc", "text", F.lit(False).alias("copy"), F.lit(None).cast("array<struct<lo:long,hi:long>>").alias("spans")
    )
    return arrow_pass(rows, schema, cut).unionByName(arrow_pass(whole, schema, cut))


class IdFilter:
    """A Bloom filter of a table's ids, sent to the tasks once."""

    def __init__(self, ids: DataFrame, id_col: str, most: int):
        bits = filter_bits(ids.count(), most)
        self.mask = (1 << bits) - 1
        bitmap = bit_filter(ids.select(F.col(id_col).bitwiseAND(F.lit(self.mask)).alias("place")), bits)
        self.sent = ids.sparkSession.sparkContext.broadcast(bitmap)

    def passes(self, ids: np.ndarray) -> np.ndarray:
        place = ids & self.mask
        bitmap = np.frombuffer(self.sent.value, np.uint8)
        return ((bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)

    def divided(self, docs: DataFrame, passing: bool) -> DataFrame:
        """Rows whose id passes, or the others: only those that may change are joined."""
        passes = self.passes

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids = batch.column("doc")
                hit = passes(ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)
                yield batch.filter(pa.array(hit == passing))

        return docs.mapInArrow(run, docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """Rows of query op9."""
    return remove_repeats(docs).select(
        F.col("doc").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )
