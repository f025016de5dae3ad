"""Guarded state changes of documents, runs and pages, as snapshots: rows that fail the guard stay as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronmill.operators.tables import update_where


def failed(documents: DataFrame, attempts: DataFrame, reason: Column) -> DataFrame:
    """Documents still in processing under the attempt that failed become failed.

    ``attempts`` has (id, attempt, stage), of which the last one of an id counts; a lease that another
    attempt took over, and a cancelled attempt (null stage), change nothing.
    """
    tried = last_attempts(attempts).where("stage IS NOT NULL").select(
        F.col("id").alias("_id"), F.col("attempt").alias("_attempt"), F.col("stage").alias("_stage")
    )
    rows = documents.join(tried, F.col("id") == F.col("_id"), "left")
    own = (F.col("status") == "processing") & (F.col("attempt") == F.col("_attempt"))
    changed = update_where(rows, own, status=F.lit("failed"), stage=F.col("_stage"), error=reason)
    return changed.select(documents.columns)


def last_attempts(attempts: DataFrame) -> DataFrame:
    """One row for each id: that of the largest attempt."""
    rest = [c for c in attempts.columns if c not in ("id", "attempt")]
    last = attempts.groupBy("id").agg(F.max(F.struct("attempt", *rest)).alias("_last"))
    return last.select("id", "_last.*")


def failure_record(stage: Column, reason: Column, detail: Column, failed_at: Column, code: Column) -> Column:
    """What is kept of a failure, as JSON: one sentence for the reader, all there is for whoever looks into it."""
    when = F.date_format(F.to_utc_timestamp(failed_at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.to_json(
        F.struct(
            stage.alias("stage"), reason.alias("error"), detail.alias("error_detail"), when.alias("failed_at"),
            F.nullif(code, F.lit("")).alias("error_code"),
        )
    )


def failed_with_record(documents: DataFrame, attempts: DataFrame, reason: Column) -> DataFrame:
    """As ``failed``, with the record in ``metadata``; attempts have (id, attempt, stage, detail, failed_at, code) besides.

    ``reason`` is over the columns of attempts with an underscore before them. Other members of ``metadata`` give way to the record.
    """
    names = ("attempt", "stage", "detail", "failed_at", "code")
    tried = last_attempts(attempts.select("id", *names)).where("stage IS NOT NULL")
    tried = tried.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in names))
    rows = documents.join(tried, F.col("id") == F.col("_id"), "left")
    own = (F.col("status") == "processing") & (F.col("attempt") == F.col("_attempt"))
    record = failure_record(F.col("_stage"), reason, F.col("_detail"), F.col("_failed_at"), F.col("_code"))
    changed = update_where(rows, own, status=F.lit("failed"), metadata=record)
    return changed.select(documents.columns)


def retried_within(documents: DataFrame, chosen: Column, active: Column, stage: Column, capacity: int, id_col: str, *order: Column) -> DataFrame:
    """Failed documents wait again as far as the queue has room, the first ones in this order.

    What is active already takes its slots; at most ``capacity`` ids are looked up. Rows that repeat an id take one slot together, rows without one stay.
    """
    waiting = F.coalesce(chosen & (F.col("status") == "failed") & F.col(id_col).isNotNull(), F.lit(False))
    free = max(0, capacity - documents.where(active).count())
    picked = documents.where(waiting).groupBy(F.col(id_col).alias("_id")).agg(*(F.min(F.struct(c)).alias(f"_o{i}") for i, c in enumerate(order)))
    ids = picked.orderBy(*(f"_o{i}" for i in range(len(order))), "_id").limit(free).select("_id")
    rows = documents.join(ids, F.col(id_col) == F.col("_id"), "left")
    # The same row may repeat an id without being chosen.
    goes = waiting & F.col("_id").isNotNull()
    return requeued(rows, goes, stage).select(documents.columns)


def requeued(documents: DataFrame, chosen: Column, stage: Column) -> DataFrame:
    """Failed documents wait again at a stage, without their error."""
    return update_where(
        documents, chosen & (F.col("status") == "failed"), status=F.lit("pending"), stage=stage, error=F.lit(None).cast("string")
    )


def reset_pages(pages: DataFrame, chosen: Column) -> DataFrame:
    """Failed pages wait again without lease and error; their checkpoint stays."""
    none = F.lit(None)
    return update_where(
        pages, chosen & (F.col("status") == "failed"), status=F.lit("pending"), phase=F.lit(""),
        error=none.cast("string"), lease_owner=none.cast("string"),
    )


def fail_unfinished(runs: DataFrame, chosen: Column, message: str) -> DataFrame:
    """Queued and running runs become failed."""
    open_ = F.col("status").isin("queued", "running")
    return update_where(runs, chosen & open_, status=F.lit("failed"), error=F.lit(message))


def assigned(rows: DataFrame, folders: DataFrame, folder_col: str, chosen: Column, folder: Column) -> DataFrame:
    """A folder is set where one with that id belongs to the row's owner (C11).

    ``folders`` has (folder, owner); ``rows`` has ``owner``.
    """
    own = folders.select(F.col("folder").alias("_folder"), F.col("owner").alias("_owner")).distinct()
    joined = rows.withColumn("_to", folder).join(own, (F.col("_to") == F.col("_folder")) & (F.col("owner") == F.col("_owner")), "left")
    return update_where(joined, chosen & F.col("_folder").isNotNull(), **{folder_col: F.col("_to")}).select(rows.columns)


def detached(rows: DataFrame, folders: DataFrame, folder_col: str, gone: Column) -> DataFrame:
    """Rows leave folders of their owner that go."""
    own = folders.where(gone).select(F.col("folder").alias("_folder"), F.col("owner").alias("_owner")).distinct()
    joined = rows.join(own, (F.col(folder_col) == F.col("_folder")) & (F.col("owner") == F.col("_owner")), "left")
    kind = rows.schema[folder_col].dataType
    return update_where(joined, F.col("_folder").isNotNull(), **{folder_col: F.lit(None).cast(kind)}).select(rows.columns)


def appended(messages: DataFrame, deltas: DataFrame) -> DataFrame:
    """Contents with the deltas of each message in their order added (K06): messages (id, content), deltas (id, seq, delta)."""
    own = deltas.groupBy(F.col("id").alias("_id")).agg(F.sort_array(F.collect_list(F.struct("seq", "delta"))).alias("_parts"))
    added = F.concat("content", F.coalesce(F.array_join(F.transform("_parts", lambda p: p["delta"]), ""), F.lit("")))
    return messages.join(own, F.col("id") == F.col("_id"), "left").withColumn("content", added).select(messages.columns)


def batch_summary(items: DataFrame, status: str, *keys: str) -> DataFrame:
    """Accepted and rejected items of each batch."""
    accepted = F.count_if(F.col(status) == "pending")
    return items.groupBy(*keys).agg(accepted.alias("accepted"), (F.count("*") - accepted).alias("rejected"))
