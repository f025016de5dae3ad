"""N-gram Jaccard join by an LSH forest of MinHash signatures, verified exactly.

1. A text's shingles are its runs of ``shingle`` words (all its words if it has
   fewer). Texts with the same set of shingles are one class with a number of its own,
   its smallest id and its number of documents. The pass stores a class key, the
   signature's values for each tree and a byte for each value of a sketch, never the sets.
2. Each tree of the forest is the sorted list of its signature prefixes of ``max_depth``
   values, which is a trie in order. Neighbours in it give each class its longest
   matched prefix; classes that match nowhere at the least depth are done.
3. The matched prefix begins at ``max_depth`` and is shortened while the recall of the
   pairs met so far is below ``recall``. It is measured from how many pairs of neighbours
   met in one tree only and how many in two (Chao's estimate of those that met in
   none), and it is never shortened below the depth at which pairs at the threshold
   meet with probability ``recall`` whatever the data.
4. Classes that share a prefix of that depth in a tree are compared by signature in blocks
   of a fixed size; those far below the threshold (``slack`` standard deviations of the
   estimate) are left out, and the others' components are candidate clusters.
5. A second pass takes the shingle sets of clustered classes only, which it knows
   by a Bloom filter of bounded size. Inside each cluster all pairs are compared
   exactly, in blocks: this counts each class's linked documents and gives the
   components of the verified links. A cluster of n classes takes n * n / 2 comparisons.

A cluster of near copies is never written as pairs: a task of two blocks returns a
count for each class and a star of edges for each component.

Defined cases: texts that are null or have no word link with nothing; rows that
share an id and their shingles count once as a partner; different texts under one id
are rows by themselves, each with the links of its own text; a row with a null id
links with nothing. Every input row gives one output row. Extra columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronmill.llm.decontaminate import WordHashes, shingle_hashes, words_of
from heronmill.llm.shared import (
    arrow_pass,
    bit_filter,
    block_tasks,
    components,
    filter_bits,
    group_starts,
    linked,
    pairs_within,
    stored,
    whole_groups,
    without_ids,
)


def shingle_set(text: str | None, shingle: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = words_of(text)
    return np.unique(shingle_hashes(words, min(shingle, len(words)), known)) if words else np.empty(0, np.uint64)


def prefix_depth(trees: int, max_depth: int, threshold: float, recall: float) -> int:
    """The longest prefix with which ``trees`` tries still reach ``recall`` at the threshold."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


class Forest:
    """MinHash signatures: ``depth`` values for each tree."""

    def __init__(self, trees: int, depth: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees, self.depth = trees, depth
        self.factors = rng.integers(1, 2**63, trees * depth, np.uint64) * np.uint64(2) + np.uint64(1)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(len(self.factors), np.iinfo(np.uint64).max, np.uint64)
        for s in range(0, len(shingles), 4096):
            np.minimum(out, np.multiply.outer(self.factors, shingles[s : s + 4096]).min(axis=1), out)
        return out

    def prefixes(self, signature: np.ndarray) -> list[bytes]:
        """Two bytes of each value, a string for each tree."""
        rows = (signature >> np.uint64(24)).astype(">u2").reshape(self.trees, self.depth)
        return [row.tobytes() for row in rows]


def signatures(docs: DataFrame, id_col: str, text_col: str, shingle: int, trees: int, depth: int, sketch: int) -> DataFrame:
    """(doc, key, prefixes, sketch) of every row; null after the id without an id or a word."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known, forest = WordHashes(), Forest(trees, depth)
        for batch in batches:
            out: dict[str, list] = {"doc": [], "key": [], "prefixes": [], "sketch": []}
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shingles = shingle_set(text, shingle, known) if doc is not None else ()
                out["doc"].append(doc)
                if len(shingles):
                    signature = forest.signature(shingles)
                    out["key"].append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    out["prefixes"].append(forest.prefixes(signature))
                    out["sketch"].append((signature[:sketch] >> np.uint64(40)).astype(np.uint8).tobytes())
                else:
                    for name in ("key", "prefixes", "sketch"):
                        out[name].append(None)
            yield out

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), text_col)
    return arrow_pass(rows, "doc long, key binary, prefixes array<binary>, sketch binary", scan)


def sorted_tries(reps: DataFrame, least: int) -> DataFrame:
    """(tree, prefix, rep, before, matched): rows in trie order that match a neighbour at ``least`` values or more.

    ``matched`` values are shared with ``before``, the row in front. Rows are dealt in ranges, which
    may cut a node: the first and the last row of a task stay, and whoever compares groups them again.
    """
    rows = reps.select("rep", F.posexplode("prefixes").alias("tree", "prefix"))
    dealt = rows.repartitionByRange("tree", "prefix", "rep").sortWithinPartitions("tree", "prefix", "rep")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        held = None  # the last row so far, with the values it shares with the one in front
        for batch in batches:
            if not len(batch):
                continue
            tree, rep = (batch.column(c).to_numpy() for c in ("tree", "rep"))
            values = np.frombuffer(b"".join(batch.column("prefix").to_pylist()), ">u2").reshape(len(batch), -1)
            depth = values.shape[1]
            before, matched = np.r_[rep[:1], rep[:-1]], np.full(len(rep), depth)  # the first row of a task stays
            same = np.logical_and.accumulate(values[1:] == values[:-1], axis=1).sum(axis=1)
            matched[1:] = np.where(tree[1:] == tree[:-1], same, 0)
            if held is not None:
                same = int(np.logical_and.accumulate(values[0] == held["values"][0]).sum())
                before[0], matched[0] = held["rep"][0], same if tree[0] == held["tree"][0] else 0
                tree, rep, values = np.r_[held["tree"], tree], np.r_[held["rep"], rep], np.r_[held["values"], values]
                before, matched = np.r_[held["before"], before], np.r_[held["matched"], matched]
            keep = (matched >= least)[:-1] | (matched[1:] >= least)
            yield rows_of(tree[:-1], values[:-1], rep[:-1], before[:-1], matched[:-1], keep)
            held = dict(tree=tree[-1:], values=values[-1:], rep=rep[-1:], before=before[-1:], matched=matched[-1:])
        if held is not None:
            yield rows_of(**{k: held[k] for k in ("tree", "values", "rep", "before", "matched")}, keep=np.ones(1, bool))

    def rows_of(tree, values, rep, before, matched, keep) -> dict:
        prefix = [v.tobytes() for v in values[keep]]
        return {"tree": tree[keep], "prefix": prefix, "rep": rep[keep], "before": before[keep], "matched": matched[keep]}

    return arrow_pass(dealt, "tree int, prefix binary, rep long, before long, matched int", scan)


def shortened(tries: DataFrame, max_depth: int, least: int, recall: float) -> int:
    """The longest depth, ``least`` or more, at which the measured recall of neighbours reaches ``recall``."""
    pairs = tries.where(f"matched >= {least} AND rep <> before").groupBy(
        F.least("rep", "before").alias("a"), F.greatest("rep", "before").alias("b")
    )
    depths = range(least, max_depth + 1)
    counts = pairs.agg(*(F.count(F.when(F.col("matched") >= d, 1)).alias(f"n{d}") for d in depths))
    sums = counts.agg(
        *(F.count(F.when(F.col(f"n{d}") >= 1, 1)).alias(f"met{d}") for d in depths),
        *(F.count(F.when(F.col(f"n{d}") == k, 1)).alias(f"f{k}_{d}") for d in depths for k in (1, 2)),
    ).first()
    for depth in reversed(depths):
        once, twice, met = sums[f"f1_{depth}"], sums[f"f2_{depth}"], sums[f"met{depth}"]
        everything = sums[f"met{least}"]
        missed = once * (once - 1) / (2 * (twice + 1))
        if met and met >= recall * max(met + missed, everything):
            return depth
    return least


def clusters(tasks: DataFrame, reps: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) between classes whose signatures agree in a share of ``least``."""
    sketches = reps.select(F.col("rep").alias("_rep"), "sketch")
    rows = tasks.join(sketches, F.col("rep") == F.col("_rep")).select("bucket", "lo", "hi", "own", "rep", "sketch")
    keys = ["bucket", "lo", "hi"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for table in whole_groups(batches, keys):
            sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(table), -1)
            rep, own, lo, hi = (table.column(c).to_numpy() for c in ("rep", "own", "lo", "hi"))
            inner = lo == hi
            got: list[tuple[np.ndarray, np.ndarray]] = []
            for a, b in pairs_within(group_starts(table, keys)):
                ok = (inner[a] | (own[a] != own[b])) & (rep[a] != rep[b])
                a, b = a[ok], b[ok]
                for s in range(0, len(a), 100_000):
                    x, y = a[s : s + 100_000], b[s : s + 100_000]
                    near = (sketch[x] == sketch[y]).mean(axis=1) >= least
                    got.append(linked(rep[x[near]], rep[y[near]]))
            if got:
                a, b = (np.concatenate(x) for x in zip(*got))
                if len(a):
                    x, y = linked(a, b)
                    yield {"a": x, "b": y}

    return arrow_pass(rows.repartition(*keys).sortWithinPartitions(*keys), "a long, b long", verify)


def place(ident: str, bits: int) -> Column:
    return F.pmod(F.xxhash64(ident), F.lit(1 << bits)).alias("place")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, wanted: DataFrame, bits: int) -> DataFrame:
    """(key, shingles) of rows whose id passes the filter of the ids ``wanted``."""
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(wanted.select(place("least", bits)), bits))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        known, bitmap = WordHashes(), np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            at = batch.column("place").to_numpy()
            hit = np.flatnonzero((bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            for s in range(0, len(hit), 256):
                some = hit[s : s + 256]
                sets = [shingle_set(batch.column("text")[i].as_py(), shingle, known).tobytes() for i in some]
                yield {"key": [xxhash.xxh3_128_digest(s) for s in sets], "shingles": sets}

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc IS NOT NULL")
    rows = rows.select("*", place("doc", bits))
    return arrow_pass(rows, "key binary, shingles binary", scan)


def small_pairs(group: np.ndarray, sets: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, common) of rows of the same small group that share shingles."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shingle = np.concatenate(sets)
    order = np.lexsort((row, shingle, group[row]))
    row, shingle = row[order], shingle[order]
    new = np.r_[True, (shingle[1:] != shingle[:-1]) | (group[row[1:]] != group[row[:-1]])]
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    for a, b in pairs_within(np.r_[np.flatnonzero(new), len(row)]):
        found, n = np.unique(row[a] * len(sets) + row[b], return_counts=True)
        both, at = np.unique(np.r_[codes, found], return_inverse=True)
        codes, counts = both, np.bincount(at, np.r_[counts, n], len(both)).astype(np.int64)
    yield codes // len(sets), codes % len(sets), counts


def large_pairs(start: int, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, common) of all rows of one large group, by adding up a matrix for each shingle."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shingle = np.concatenate(sets)
    order = np.argsort(shingle, kind="stable")
    row, shingle = row[order], shingle[order]
    ends = np.r_[np.flatnonzero(shingle[1:] != shingle[:-1]) + 1, len(row)]
    common = np.zeros((len(sets), len(sets)), np.int32)
    begin = 0
    for end in ends.tolist():
        if end - begin > 1:
            own = row[begin:end]
            common[np.ix_(own, own)] += 1
        begin = end
    a, b = np.nonzero(np.triu(common, 1))
    return a + start, b + start, common[a, b]


def verified(tasks: DataFrame, sets: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """Rows (rep, n) of linked documents and (a, b) of edges, from all pairs of each cluster."""
    payload = sets.join(reps.select("rep", "copies", "key"), "key").select(F.col("rep").alias("_rep"), "copies", "shingles")
    rows = tasks.join(payload, F.col("rep") == F.col("_rep")).select(
        "root", "lo", "hi", "own", "rep", "copies", "shingles"
    )
    keys = ["root", "lo", "hi"]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for table in whole_groups(batches, keys, rows=256):
            starts = group_starts(table, keys)
            rep, own, copies, lo, hi = (table.column(c).to_numpy() for c in ("rep", "own", "copies", "lo", "hi"))
            sets = [np.frombuffer(b, np.uint64) for b in table.column("shingles").to_pylist()]
            size = np.array([len(s) for s in sets])
            group = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            large = [g for g in range(len(starts) - 1) if starts[g + 1] - starts[g] > 24]
            found = [large_pairs(starts[g], sets[starts[g] : starts[g + 1]]) for g in large]
            rest = np.flatnonzero(~np.isin(group, large))
            if len(rest):
                found += [(rest[a], rest[b], n) for a, b, n in small_pairs(group[rest], [sets[i] for i in rest])]
            total = np.zeros(len(rep), np.int64)
            edges = []
            for a, b, common in found:
                ok = (lo[a] == hi[a]) | (own[a] != own[b])
                ok &= common >= threshold * (size[a] + size[b] - common) - 1e-9
                a, b = a[ok], b[ok]
                np.add.at(total, a, copies[b])
                np.add.at(total, b, copies[a])
                edges.append(linked(rep[a], rep[b]))
            x, y = (np.concatenate(e) for e in zip(*edges))
            some = np.flatnonzero(total)
            nulls = [None] * len(x)
            yield {
                "rep": [*rep[some].tolist(), *nulls],
                "n": [*total[some].tolist(), *nulls],
                "a": [*[None] * len(some), *x.tolist()],
                "b": [*[None] * len(some), *y.tolist()],
            }

    return arrow_pass(rows.repartition(*keys).sortWithinPartitions(*keys), "rep long, n long, a long, b long", verify)


def similar_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    threshold: float = 0.8,
    trees: int = 32,
    max_depth: int = 8,
    recall: float = 0.9999,
    slack: float = 5.0,
    block: int = 256,
    bits: int = 28,
) -> DataFrame:
    """(doc, class_id, n_links, component_id, kept) for every row of ``docs``."""
    least = prefix_depth(trees, max_depth, threshold, recall)
    sketch = 6 * trees
    signed = stored(signatures(docs, id_col, text_col, shingle, trees, max_depth, sketch), "signatures")
    same = signed.where("key IS NOT NULL").groupBy("key")
    reps = same.agg(
        F.min("doc").alias("least"),
        F.count_distinct("doc").alias("copies"),
        F.first("sketch").alias("sketch"),
        F.first("prefixes").alias("prefixes"),
    )
    reps = stored(reps.withColumn("rep", F.monotonically_increasing_id()), "text-classes")
    tries = stored(sorted_tries(reps, least), "tries")
    depth = shortened(tries, max_depth, least, recall)
    bucket = F.xxhash64("tree", F.substring("prefix", 1, 2 * depth)).alias("bucket")
    agreeing = threshold - slack * np.sqrt(threshold * (1 - threshold) / sketch)
    near = clusters(block_tasks(tries.select(bucket, "rep"), "bucket", "rep", block), reps, float(agreeing))
    cluster = stored(components(near).select("root", F.col("id").alias("rep")), "text-clusters")
    wanted = stored(cluster.join(reps.select("rep", "least"), "rep"), "clustered-ids")
    sets = shingle_sets(docs, id_col, text_col, shingle, wanted, filter_bits(wanted.count(), bits)).dropDuplicates(["key"])
    checked = stored(verified(block_tasks(cluster, "root", "rep", block), sets, reps, threshold), "verified-links")
    links = checked.where("rep IS NOT NULL").groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(checked.where("a IS NOT NULL").select("a", "b")).withColumnRenamed("id", "rep")
    member = roots.join(reps.select("rep", "least"), "rep")
    smallest = member.groupBy("root").agg(F.min("least").alias("component"))
    per_class = (
        reps.select("rep", "key", "least", "copies")
        .join(links, "rep", "left")
        .join(member.join(smallest, "root").select("rep", "component"), "rep", "left")
        .select(
            "key",
            F.col("least").alias("class_id"),
            (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"),
            F.coalesce("component", "least").alias("component_id"),
        )
    )
    return (
        signed.select("doc", "key")
        .join(stored(per_class, "text-links"), "key", "left")
        .select(
            "doc",
            F.coalesce("class_id", "doc").alias("class_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "doc").alias("component_id"),
            (F.col("doc").isNull() | (F.col("doc") == F.coalesce("component_id", "doc"))).alias("kept"),
        )
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one document, the smallest id, of each group of similar ones.

    Rows with a null id stay; where an id has several texts, all stay if one of them does.
    """
    found = similar_documents(docs, id_col, text_col, **options).groupBy("doc").agg(F.bool_or("kept").alias("kept"))
    return without_ids(docs, id_col, found.where("NOT kept").select("doc"))


def digest(docs: DataFrame) -> DataFrame:
    """Rows of query op2."""
    return similar_documents(docs).withColumnRenamed("doc", "doc_id")
