"""Relational operators over snapshots: pages, sequences, existence, upserts, leases.

Tables are Parquet snapshots: an update takes a snapshot and returns the next one.
Guards that a database checks under a lock hold here for one writer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronmill.sources.storage import stored

#: Tasks at least for keys of whole tables.
LEAST_PARTS = 128


def normalize_page(page: int, size: int, default: int = 20, most: int = 100) -> tuple[int, int]:
    """Page from 1, page size from 1 to ``most``."""
    return max(page, 1), default if size <= 0 else min(size, most)


def normalize_limit(limit: int, default: int = 50, most: int = 500) -> int:
    """A limit from 1 to ``most``."""
    return default if limit <= 0 else min(limit, most)


def offset_page(df: DataFrame, page: int, size: int, *order: Column) -> DataFrame:
    """One page in this order; sorts only the rows up to its end."""
    page, size = normalize_page(page, size)
    return df.orderBy(*order).limit(page * size).offset((page - 1) * size)


def keyset_page(df: DataFrame, column: str, after: int, limit: int) -> DataFrame:
    """The next rows after a cursor, which is a pushed-down filter."""
    return df.where(F.col(column) > after).orderBy(column).limit(normalize_limit(limit))


def first_per_group(df: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    """The first row of each group in this order."""
    window = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def next_numbers(log: DataFrame, key: str, number: str) -> DataFrame:
    """The number that follows each key's largest, from partial maxima."""
    return log.groupBy(key).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias("next_no"))


def append_numbered(log: DataFrame, new: DataFrame, key: str, number: str, *order: Column) -> DataFrame:
    """``new`` rows with gap-free numbers after the log's."""
    starts = next_numbers(log, key, number).withColumnRenamed(key, "_key")
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return (
        new.join(starts, F.col(key) == F.col("_key"), "left")
        .withColumn(number, (F.coalesce("next_no", F.lit(1)) - 1 + place).cast("long"))
        .drop("_key", "next_no")
    )


def counts_with_zero(parents: DataFrame, children: DataFrame, parent: str, child: str, name: str) -> DataFrame:
    """Children of each parent, zero included; children are summed before the join."""
    counts = children.groupBy(F.col(child).alias("_child")).count()
    joined = parents.join(counts, F.col(parent) == F.col("_child"), "left")
    return joined.withColumn(name, F.coalesce("count", F.lit(0))).drop("_child", "count")


def missing_children(parents: DataFrame, parts: DataFrame, made: DataFrame, parent: str, part: str, of: str, by: str) -> DataFrame:
    """Parents with at least one part that nothing was made for."""
    lacking = parts.join(made.select(F.col(by).alias("_made")), F.col(part) == F.col("_made"), "left_anti")
    return parents.join(lacking.select(F.col(of).alias("_of")), F.col(parent) == F.col("_of"), "left_semi")


def insert_absent(existing: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The snapshot after inserting the rows whose keys are not there."""
    return existing.unionByName(new.join(existing.select(*keys), list(keys), "left_anti"))


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str], keep: Column | None = None) -> DataFrame:
    """The snapshot after replacing and inserting rows by key.

    ``keep`` says, in terms of ``old.`` and ``new.`` columns, when an old row stays.
    """
    a, b = old.alias("old"), new.alias("new")
    on = [F.col(f"old.{k}") == F.col(f"new.{k}") for k in keys]
    has_new = F.col(f"new.{keys[0]}").isNotNull()
    use_new = has_new if keep is None else has_new & ~F.coalesce(keep, F.lit(False))
    columns = [F.when(use_new, F.col(f"new.{c}")).otherwise(F.col(f"old.{c}")).alias(c) for c in old.columns]
    return a.join(b, on, "full").select(*columns)


def update_where(df: DataFrame, condition: Column, **values: Column) -> DataFrame:
    """The snapshot after setting columns where the condition is true."""
    hit = F.coalesce(condition, F.lit(False))
    return df.withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in values.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """The snapshot without the rows for which the condition is true."""
    return df.where(~F.coalesce(condition, F.lit(False)))


def delete_children(children: DataFrame, gone: DataFrame, child: str, parent: str) -> DataFrame:
    """What a cascade leaves: children of parents that stay."""
    return children.join(gone.select(F.col(parent).alias("_gone")), F.col(child) == F.col("_gone"), "left_anti")


def acquire_leases(rows: DataFrame, owner: str, now: Column, seconds: int) -> DataFrame:
    """Leases taken where there is none, an expired one, or the caller's own."""
    free = F.col("lease_owner").isNull() | (F.col("lease_until") < now) | (F.col("lease_owner") == owner)
    until = now + F.make_interval(secs=F.lit(seconds))
    return update_where(rows, free, lease_owner=F.lit(owner), lease_until=until)


def exclusive_toggle(rows: DataFrame, owner_col: str, id_col: str, flag: str, owner: int, chosen: int) -> DataFrame:
    """One active row for an owner."""
    return update_where(rows, F.col(owner_col) == owner, **{flag: F.col(id_col) == chosen})


def distinct_by(df: DataFrame, key: Column, *order: Column) -> DataFrame:
    """The first row of each key: whole-row deduplication by a digest."""
    keyed = df.withColumn("_key", key)
    return first_per_group(keyed, ["_key"], *order).drop("_key")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """How many rows break each rule, in one pass: what constraints would refuse."""
    sums = [F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()]
    return df.agg(*sums)


def running_sum(df: DataFrame, size: Column, name: str, *order: Column, by: Sequence[str] = ()) -> DataFrame:
    """``df`` with the sum of ``size`` up to each row of its key in this order, without a task that holds a whole key.

    Rows are dealt by ranges of (key, order) and stored. A range adds up by itself, and to that comes what the ranges before
    have of the same key: one number for each key and range. Null sizes count as nothing; rows that agree in
    key and order are taken in any order.
    """
    spark = df.sparkSession
    keys, at, own = (new_column(df, c) for c in ("_keys", "_range", "_size"))
    rows = df.withColumns({own: F.coalesce(size, F.lit(0)).cast("long"), keys: F.struct(*by) if by else F.lit(0)})
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(ranges, F.asc(keys), *order).withColumn(at, F.spark_partition_id())
    dealt = stored(dealt, "running-sum")
    sums = dealt.groupBy(F.col(keys).alias("_k"), F.col(at).alias("_r")).agg(F.sum(own).alias("_sum"))
    earlier = Window.partitionBy("_k").orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_k", "_r", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(keys, at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = dealt.withColumn(name, F.sum(own).over(inside))
    joined = summed.join(before, F.col(keys).eqNullSafe(F.col("_k")) & (F.col(at) == F.col("_r")))
    return joined.withColumn(name, F.col(name) + F.col("_before")).drop(keys, at, own, "_k", "_r", "_before")


def dealt_by(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` dealt by its keys to a number of tasks that adaptive execution does not lessen.

    Numbers shrink so much in a shuffle that tasks joined by their bytes would hold many millions of keys.
    """
    parts = max(LEAST_PARTS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *keys)


def key_counts(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n_left, n_right): rows of either side with the keys, by one shuffle and without a join; nulls are a key."""
    one, other = (df.select(*keys, F.lit(n).alias("_left")) for df, n in ((left, True), (right, False)))
    rows = dealt_by(one.unionByName(other), keys)
    return rows.groupBy(*keys).agg(F.count_if("_left").alias("n_left"), F.count_if(~F.col("_left")).alias("n_right"))


def new_column(df: DataFrame, name: str) -> str:
    """``name``, with underscores in front until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name
