"""What several operators of this subpackage use: typed Arrow passes, filters, groups, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from heronmill.sources.storage import stored

def new_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def without_ids(df: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """Rows of ``df`` whose id is not in the only column of ``gone``; null ids stay."""
    name = new_name(df, "_gone")
    ids = gone.toDF(name).distinct()
    return df.join(ids, F.col(f"`{id_col}`").cast("long") == F.col(name), "left_anti")


def arrow_pass(
    df: DataFrame,
    schema: str | StructType,
    rows: Callable[[Iterator[pa.RecordBatch]], Iterator[dict[str, list]]],
) -> DataFrame:
    """``mapInArrow`` for functions that yield columns as dicts of lists or arrays."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in rows(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[f.name], type=f.type, from_pandas=False) for f in arrow], schema=arrow
            )

    return df.mapInArrow(run, kind)


def signed(h: int) -> int:
    """A 64-bit hash as Spark's signed long."""
    return h - (1 << 64) if h >> 63 else h


#: A-Z to a-z and nothing else.
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def ascii_lower(s: str) -> str:
    return s.lower() if s.isascii() else s.translate(ASCII_LOWER)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 8192) -> Iterator[pa.Table]:
    """Tables of about ``rows`` rows that never cut a group, from rows sorted by ``keys``."""
    held: list[pa.RecordBatch] = []

    def same(a: pa.RecordBatch, i: int, b: pa.RecordBatch, j: int) -> bool:
        return all(a.column(k)[i].equals(b.column(k)[j]) for k in keys)

    count = 0
    for batch in batches:
        if not len(batch):
            continue
        if held and count >= rows:
            cut = next((i for i in range(len(batch)) if not same(batch, i, held[-1], len(held[-1]) - 1)), len(batch))
            if cut:
                held.append(batch.slice(0, cut))
            if cut < len(batch):
                yield pa.Table.from_batches(held)
                held, count, batch = [], 0, batch.slice(cut)
            else:
                continue
        # The last group of a batch may go on in the next one: it waits there.
        held.append(batch)
        count += len(batch)
    if held:
        yield pa.Table.from_batches(held)


def group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    """Where groups of equal keys begin, and the table's length at the end."""
    new = np.zeros(len(table), bool)
    new[:1] = True
    for k in keys:
        values = table.column(k).to_numpy()
        new[1:] |= values[1:] != values[:-1]
    return np.r_[np.flatnonzero(new), len(table)]


def pairs_within(starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of places in the same group, some thousands of groups at a time.

    Groups are as small as ``block_tasks`` makes them, so this is bounded.
    """
    sizes = np.diff(starts)
    per_row = np.repeat(starts[1:], sizes) - np.arange(starts[-1]) - 1
    ends = np.cumsum(per_row)
    done = 0
    while done < len(per_row):
        base = ends[done - 1] if done else 0
        upto = max(done + 1, int(np.searchsorted(ends, base + 2_000_000, "right")))
        n = per_row[done:upto]
        left = np.repeat(np.arange(done, upto), n)
        step = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        yield left, left + 1 + step
        done = upto


def linked(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the graph of these ids: its other ids and its smallest."""
    ids, at = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = at[: len(left)], at[len(left) :]
    root = np.arange(len(ids))
    while True:
        least = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        new = np.minimum(new, new[new])
        if (new == root).all():
            break
        root = new
    rest = root != np.arange(len(ids))
    return ids[rest], ids[root[rest]]


def block_tasks(members: DataFrame, key: str, ident: str, block: int) -> DataFrame:
    """``members`` dealt to tasks so that every two members of a key meet in one.

    Keys with one member go. A key of more than ``block`` members is split into
    blocks by a hash of the id; each pair of blocks is a task, so no task grows
    with a key. Adds ``lo`` and ``hi``, the task's blocks, and ``own``, the row's.
    """
    sizes = members.groupBy(key).count().where("count > 1")
    counts = stored(sizes.select(F.col(key).alias("_key"), F.ceil(F.col("count") / block).cast("int").alias("_n")), "sizes")
    own = F.pmod(F.xxhash64(ident), F.col("_n")).cast("int")
    return (
        members.join(counts, F.col(key) == F.col("_key"))
        .withColumn("own", own)
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        .withColumn("lo", F.least("own", "_other"))
        .withColumn("hi", F.greatest("own", "_other"))
        .drop("_key", "_n", "_other")
    )


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every id of the edges (a, b); the root is the component's smallest id.

    Every round each id goes to its first neighbour in the round's order of ids and
    the edges between the places reached stay, until none are left. The order is
    that of the ids at first, which ends stars at once, and then a new random one
    for each round, under which any component shrinks geometrically.
    """
    left = stored(edges.where("a <> b").select("a", "b").distinct(), "edges")
    moves: list[DataFrame] = []
    while not left.isEmpty():
        turn = len(moves)

        def order(c: str) -> Column:
            rank = F.col(c) if turn == 0 else F.xxhash64(F.col(c), F.lit(turn))
            return F.struct(rank.alias("rank"), F.col(c).alias("node"))

        both = left.select("a", "b").unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = both.groupBy("a").agg(F.min(order("b")).alias("best"))
        to = F.when(F.col("best") < order("a"), F.col("best.node")).otherwise(F.col("a"))
        move = stored(first.select(F.col("a").alias("at"), to.alias("to")), "moves")
        moves.append(move)
        left = stored(
            left.join(move, left["a"] == move["at"])
            .select(F.col("to").alias("a"), "b")
            .join(move.withColumnRenamed("to", "to_b"), F.col("b") == F.col("at"))
            .select("a", F.col("to_b").alias("b"))
            .where("a <> b")
            .distinct(),
            "edges",
        )
    if not moves:
        return left.select(F.col("a").alias("id"), F.col("b").alias("root"))
    places = moves[0].select(F.col("at").alias("id"), F.col("to").alias("place"))
    for move in moves[1:]:
        places = places.join(move, F.col("place") == F.col("at"), "left").select(
            "id", F.coalesce("to", "place").alias("place")
        )
    places = stored(places, "places")
    least = stored(places.groupBy("place").agg(F.min("id").alias("root")), "roots")
    return places.join(least, "place").select("id", "root")


def filter_bits(keys: int, most: int) -> int:
    """The size of a filter with 16 bits or more for each key, from 2 ** 12 bits to 2 ** ``most``.

    A table with more keys than the largest filter holds has more false hits, which exact steps refuse.
    """
    return min(most, max(12, (16 * keys).bit_length()))


def bit_filter(places: DataFrame, bits: int) -> bytes:
    """One-probe Bloom filter of the column ``place``, from 0 to ``2 ** bits``: ``2 ** bits / 8`` bytes."""
    parts = (
        places.select(
            F.shiftright("place", 12).alias("part"), F.col("place").bitwiseAND(F.lit(4095)).cast("short").alias("bit")
        )
        .groupBy("part")
        .agg(F.collect_set("bit").alias("set"))  # 4096 values at most
    )
    out = bytearray(1 << (bits - 3))
    for row in parts.toLocalIterator():
        own = np.zeros(4096, bool)
        own[row.set] = True
        out[row.part * 512 : (row.part + 1) * 512] = np.packbits(own, bitorder="little").tobytes()
    return bytes(out)
