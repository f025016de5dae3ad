"""Unit cases of pages, material, ingest, dialogue, filters and streams."""

import random
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from heronmill.operators import dialogue as D
from heronmill.operators import filters as L
from heronmill.operators import ingest as I
from heronmill.operators import material as M
from heronmill.operators import pages as P
from heronmill.plans import load_plans
from heronmill.plans.registry import ORACLES, QUERIES
from heronmill.sources.storage import Scratch, stored
from heronmill.streaming import events as S


def test_filters():
    with pytest.raises(ValueError):
        L.ChunkFilter(document_ids=(0,))
    with pytest.raises(ValueError):
        L.ChunkFilter(created_from=datetime(2024, 2, 1), created_to=datetime(2024, 1, 1))
    with pytest.raises(ValueError):
        L.ChunkFilter(document_ids=tuple(range(1, 300)))
    assert L.ChunkFilter(document_ids=(3, 3, 1)).document_ids == (3, 1)
    assert L.parse_statuses(" ready, failed,ready") == ("ready", "failed")
    with pytest.raises(ValueError):
        L.parse_statuses("gone")


def test_levels_leave_cycles_out(spark):
    rows = [(1, "a", 0, []), (1, "b", 1, ["a"]), (1, "c", 2, ["a", "b"]), (2, "x", 0, ["y"]), (2, "y", 1, ["x"])]
    pages = spark.createDataFrame(rows, "plan_id long, page_id string, position int, prerequisites array<string>")
    assert {(r.page_id, r.level) for r in P.levels(pages).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    broken = {r.plan_id: r.broken for r in P.plan_violations(pages).collect()}
    assert broken == {1: [], 2: ["forward_dependency"]}


def test_subtrees_and_sections(spark):
    rows = [(1, "A", 10, 0), (1, "A/B", 5, 1), (1, "A/B/C", 1, 2), (1, "D", 7, 3)]
    df = spark.createDataFrame(rows, "doc long, path string, size int, at int")
    sizes = {r.section: r.chars for r in M.subtree_sizes(df, "doc", "path", "size").collect()}
    assert sizes == {"A": 20, "A/B": 8, "A/B/C": 1, "D": 7}
    order = [r.path for r in M.sections_to_summarise(df, "doc", "path", "at").orderBy("place").collect()]
    assert order == ["A", "D", "A/B", "A/B/C"]


def test_ingest_states(spark):
    docs = spark.createDataFrame([(1, "# T\n\ntext", "a.md"), (2, " ", "b.md"), (3, None, None)], "doc_id long, text string, source string")
    state, chunks, vectors = I.ingest(docs)
    assert {r.doc_id: r.status for r in state.collect()} == {1: "ready", 2: "failed", 3: "failed"}
    assert I.vector_violations(chunks, vectors).count() == 0
    stages = {r.doc_id: r.stage for r in I.recovery_stage(docs, chunks).collect()}
    assert stages == {1: "embed", 2: "parse", 3: "error"}
    assert abs(sum(x * x for x in vectors.first().embedding) - 1) < 1e-5


def test_register_and_claim(spark):
    old = spark.createDataFrame([(7, "d1")], "owner_id long, digest string")
    new = spark.createDataFrame([(1, 7, "d1"), (2, 7, "d2"), (3, 7, "d2"), (4, 8, "d1")], "doc_id long, owner_id long, digest string")
    fresh = I.register(old, new)
    assert {r.doc_id for r in fresh.collect()} == {2, 4}
    assert {(r.status, r.attempt) for r in I.claim(fresh).collect()} == {("processing", 1)}


def test_chunk_buckets_are_replaced(spark, tmp_path):
    schema = "document_id long, content string"
    I.write_chunks(spark, spark.createDataFrame([(1, "a"), (2, "b")], schema), f"{tmp_path}/c")
    I.write_chunks(spark, spark.createDataFrame([(1, "new")], schema), f"{tmp_path}/c")
    assert {(r.document_id, r.content) for r in spark.read.parquet(f"{tmp_path}/c").collect()} == {(1, "new"), (2, "b")}


def test_page_numbers_in_questions(spark):
    asked = {"第3页": 3, "第 12 页": 12, "第十页": 10, "第十二页": 12, "第二十页": 20, "第九十九页": 99, "page": None}
    df = spark.createDataFrame([(k,) for k in asked], "q string").select("q", D.page_asked_for(F.col("q")).alias("n"))
    assert {r.q: r.n for r in df.collect()} == asked


def test_late_numbers_are_ignored(spark, tmp_path):
    """A fold over two files in order; a number seen before changes nothing."""
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"
    t = datetime(2024, 1, 1)
    first = [(1, t, 5, "click", 1.0), (3, t, 5, "purchase", 10.0)]
    second = [(2, t, 5, "purchase", 99.0), (3, t, 5, "purchase", 10.0), (4, t, 5, "view", 1.0)]
    spark.createDataFrame(first, schema).coalesce(1).write.parquet(f"{tmp_path}/e")
    spark.createDataFrame(second, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    kind = spark.read.parquet(f"{tmp_path}/e").schema
    updates = S.drain(S.fold_events(S.read_stream(spark, f"{tmp_path}/e", kind, 1)), "late", "update")
    got = S.latest_states(updates, "user_id").first()
    assert (got.last_seq, got.state, got.spent, got.n) == (4, "view", 10.0, 3)


def test_streams_count_every_row(spark, tmp_path):
    """70 files in no order; one user has more rows than a frame of Arrow holds."""
    rnd = random.Random(3)
    start = datetime(2024, 1, 1)
    ids = list(range(35_000))
    rnd.shuffle(ids)
    rows = [
        (i, start + timedelta(seconds=10 * i), 0 if i % 2 else rnd.randint(1, 400), rnd.choice(["click", "purchase"]), float(i % 7))
        for i in ids
    ]
    columns = "event_id", "ts", "user_id", "event_type", "value"
    (tmp_path / "events.parquet").mkdir()
    for k in range(70):
        own = zip(*rows[k * 500 : k * 500 + 500])
        pq.write_table(pa.table(dict(zip(columns, map(list, own)))), f"{tmp_path}/events.parquet/{k}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    load_plans()
    for name in ("k08_stream_fold", "n05_stream_windows"):
        relation = con.sql(ORACLES[name])
        got = QUERIES[name](spark, str(tmp_path)).select(*relation.columns).collect()
        assert sorted(map(tuple, got)) == sorted(relation.fetchall())
    times, want = {}, []
    for _, t, user, *_ in sorted(rows):
        if user in times and t - times[user][-1] <= timedelta(minutes=30):
            times[user].append(t)
        else:
            times[user] = [t]
            want.append((user, times[user]))
    closed = max(r[1] for r in rows) - timedelta(minutes=10)
    want = [(u, ts[0], ts[-1] + timedelta(minutes=30), len(ts)) for u, ts in want if ts[-1] + timedelta(minutes=30) <= closed]
    assert sorted(map(tuple, QUERIES["n06_stream_sessions"](spark, str(tmp_path)).collect())) == sorted(want)


def test_repeated_numbers_in_frames_of_a_batch(spark, tmp_path):
    """Each number is given three times, in files that are read at once."""
    rows = spark.range(12_000).select(
        F.col("id").alias("event_id"), F.lit(5).cast("long").alias("user_id"), F.lit("purchase").alias("event_type"), F.lit(1.0).alias("value")
    )
    for _ in range(3):
        rows.orderBy(F.rand(1)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/e")
    updates = S.drain(S.fold_events(S.read_stream(spark, f"{tmp_path}/e", rows.schema, None)), "repeated", "update")
    got = S.latest_states(updates, "user_id").first()
    assert (got.last_seq, got.spent, got.n) == (11_999, 12_000.0, 12_000)


def test_whole_texts_are_read(spark, tmp_path):
    """What stands far behind in a text is packed and asked for too."""
    load_plans()
    text = "A sentence of some words. " * 400 + "The last one."
    kind = "conv_id long, turn int, role string, text string"
    spark.createDataFrame([(1, 1, "user", text)], kind).write.parquet(f"{tmp_path}/conversations.parquet")
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    pieces = QUERIES["h44_packed_sentences"](spark, str(tmp_path)).orderBy("piece").collect()
    assert "".join("".join(r.text for r in pieces).split()) == "".join(text.split())
    assert QUERIES["h03_strip_request"](spark, str(tmp_path)).first().asked.count("sentence") == 400


def test_scratch(spark):
    scratch = Scratch(spark)
    df = scratch.stored(spark.range(3), "three")
    assert df.count() == 3
    kept = stored(df, "kept")
    scratch.clear()
    assert kept.count() == 3 and scratch.paths == []


def test_running_sums_of_hot_keys(spark):
    """A key with most rows, null keys and sizes, against a loop."""
    from heronmill.operators.tables import running_sum

    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 8 + ["b", None]), i, rnd.choice([None, 1, 5, 7])) for i in range(800)]
    df = spark.createDataFrame(rows, "k string, i long, n long").withColumn("_keys", F.lit("extra")).repartition(7)
    got = {r.i: (r.k, r.s, r["_keys"]) for r in running_sum(df, F.col("n"), "s", F.asc("i"), by=["k"]).collect()}
    sums = {}
    for k, i, n in rows:
        sums[k] = sums.get(k, 0) + (n or 0)
        assert got[i] == (k, sums[k], "extra")
    total = 0
    got = {r.i: r.s for r in running_sum(df, F.col("n"), "s", F.desc("i")).collect()}
    for _, i, n in reversed(rows):
        total += n or 0
        assert got[i] == total
    assert running_sum(df.limit(0), F.col("n"), "s", F.asc("i"), by=["k"]).count() == 0


def test_failures_of_several_attempts(spark):
    """The last attempt counts, a cancelled or foreign one changes nothing, and no row is multiplied."""
    from heronmill.operators import states as S

    docs = spark.createDataFrame(
        [(1, "processing", 2, "{}"), (2, "processing", 2, "{}"), (3, "ready", 1, "{}"), (4, "processing", 1, "{}"), (5, "processing", 1, "{}")],
        "id int, status string, attempt int, metadata string",
    ).withColumn("code", F.lit("extra"))
    at = datetime(2026, 1, 2, 3, 4, 5)
    tries = [(1, 1, "parse", "a", at, ""), (1, 2, "embed", "b", at, "E1"), (2, 2, None, "c", at, ""), (3, 1, "parse", "d", at, ""), (4, 1, "parse", None, at, ""), (4, 2, "parse", "x", at, "")]
    attempts = spark.createDataFrame(tries, "id int, attempt int, stage string, detail string, failed_at timestamp, code string")
    got = {r.id: (r.status, r.metadata) for r in S.failed_with_record(docs, attempts, F.lit("sorry")).collect()}
    record = '{"stage":"embed","error":"sorry","error_detail":"b","failed_at":"2026-01-02T03:04:05Z","error_code":"E1"}'
    assert got == {1: ("failed", record), 2: ("processing", "{}"), 3: ("ready", "{}"), 4: ("processing", "{}"), 5: ("processing", "{}")}
    assert S.failed_with_record(docs, attempts, F.lit("x")).count() == 5


def test_retries_within_capacity(spark):
    from heronmill.operators import states as S

    rows = [(i, "failed" if i % 2 else "pending", "parse", "bad") for i in range(10)] + [(None, "failed", "parse", "bad"), (1, "failed", "parse", "bad")]
    docs = spark.createDataFrame(rows, "id int, status string, stage string, error string")
    active = F.col("status") == "pending"
    for capacity, want in ((0, []), (5, []), (7, [7, 9]), (100, [1, 1, 3, 5, 7, 9])):
        out = S.retried_within(docs, F.lit(True), active, F.lit("chunk"), capacity, "id", -F.col("id"))
        assert out.count() == len(rows)
        assert sorted(r.id for r in out.where("stage = 'chunk' AND status = 'pending' AND error IS NULL").collect()) == want
