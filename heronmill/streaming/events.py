"""Event streams: resumable tails, idempotent folds, windows, retention.

A stream reads files of a folder; each run with ``availableNow`` takes what is new
since its checkpoint, so a restart goes on where the last run ended.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from heronmill.sources.storage import fresh_path

FOLD = "user_id long, last_seq long, state string, spent double, n long"


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = 64) -> DataFrame:
    """Rows of the Parquet files under a path as a stream.

    Rows that are behind those of an earlier batch are late. Files in no order of
    events need None, by which all that there are at the start make one batch.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is and read what it wrote.

    ``append`` uses the file sink, which is exactly-once. For ``update`` each batch
    is written under its number, so a repeated batch replaces itself.
    """
    spark = stream.sparkSession
    out, marks = fresh_path(spark, name), fresh_path(spark, f"{name}-marks")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", marks).trigger(availableNow=True)
    if mode == "append":
        writer.format("parquet").option("path", out).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(out)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer.foreachBatch(write).start().awaitTermination()
    schema = StructType([*stream.schema.fields]).add("batch", "long")
    return spark.read.schema(schema).parquet(out)


def windowed_counts(events: DataFrame, width: str, late: str, *by: str) -> DataFrame:
    """Counts in tumbling windows; rows later than ``late`` are left out."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = rows.groupBy(F.window("ts", width).alias("w"), *by).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").alias("start"), *by, "n")


def session_counts(events: DataFrame, gap: str, late: str, key: str) -> DataFrame:
    """Counts in sessions that end after a gap."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    counts = rows.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def fold_events(events: DataFrame) -> DataFrame:
    """State of each key after its events in order; a number not above the last of earlier batches is ignored.

    A key's rows of one batch come in several frames of no order. The numbers seen
    in the batch are held, 8 bytes each.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, kind, spent, n = state.get if state.exists else (-1, None, 0.0, 0)
        before = last
        seen: list[np.ndarray] = []  # sorted, each more than twice as long as the next
        for rows in batches:
            rows = rows.sort_values("event_id").drop_duplicates("event_id")
            rows = rows[rows["event_id"] > before]
            for ids in seen:
                at = np.searchsorted(ids, rows["event_id"])
                rows = rows[ids[np.minimum(at, len(ids) - 1)] != rows["event_id"]]
            if len(rows):
                if rows["event_id"].iloc[-1] > last:
                    last, kind = int(rows["event_id"].iloc[-1]), rows["event_type"].iloc[-1]
                spent += float(rows.loc[rows["event_type"] == "purchase", "value"].sum())
                n += len(rows)
                own = rows["event_id"].to_numpy(np.int64)
                while seen and len(seen[-1]) <= 2 * len(own):
                    own = np.sort(np.concatenate([seen.pop(), own]), kind="stable")
                seen.append(own)
        state.update((last, kind, spent, n))
        yield pd.DataFrame({"user_id": [key[0]], "last_seq": [last], "state": [kind], "spent": [spent], "n": [n]})

    return events.groupBy("user_id").applyInPandasWithState(
        step, FOLD, "last_seq long, state string, spent double, n long", "update", GroupStateTimeout.NoTimeout
    )


def latest_states(updates: DataFrame, key: str) -> DataFrame:
    """The last update of each key."""
    columns = [c for c in updates.columns if c not in (key, "batch")]
    last = F.max_by(F.struct(*columns), "batch").alias("last")
    return updates.groupBy(key).agg(last).select(key, *(F.col(f"last.{c}") for c in columns))


def first_seen(events: DataFrame, key: str, late: str) -> DataFrame:
    """Each key's first row within the time that rows may be late."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.dropDuplicatesWithinWatermark([key])


def server_sent(events: DataFrame) -> DataFrame:
    """Rows as lines of a server-sent event stream."""
    payload = F.to_json(F.struct("user_id", "value"))
    line = F.format_string("id: %d\nevent: %s\ndata: %s\n\n", "event_id", "event_type", payload)
    return events.select("event_id", line.alias("line"))


def parsed_line(line):
    """The payload of a ``data:`` line; null for other lines and the end mark."""
    body = F.trim(F.regexp_extract(line, r"^data:(.*)$", 1))
    return F.when((body != "") & (body != "[DONE]"), body)
