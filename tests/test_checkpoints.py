"""Hashes by content and the pages that a new plan keeps, against loops."""

import json
import random

from pyspark.sql import functions as F

from heronmill.operators import checkpoints as K


def shuffled(value, rnd):
    if isinstance(value, dict):
        items = [(k, shuffled(v, rnd)) for k, v in value.items()]
        rnd.shuffle(items)
        return dict(items)
    return [shuffled(v, rnd) for v in value] if isinstance(value, list) else value


def value_of(rnd, depth=3):
    kind = rnd.randint(0, 5)
    if depth and kind < 2:
        return {rnd.choice("abcé") + str(i): value_of(rnd, depth - 1) for i in range(rnd.randint(0, 4))}
    if depth and kind == 2:
        return [value_of(rnd, depth - 1) for _ in range(rnd.randint(0, 4))]
    return rnd.choice([1, -2, "x", 'q"\\', None, True, "é"])


def test_hashes_follow_content_only(spark):
    rnd = random.Random(1)
    values = [value_of(rnd) for _ in range(150)]
    rows = [(i, json.dumps(v), json.dumps(shuffled(v, rnd), indent=rnd.choice([None, 2]), ensure_ascii=False)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "i int, a string, b string")
    hashes = df.select("i", K.content_hash(page=F.col("a"), kind=F.lit('"x"')).alias("a"), K.content_hash(kind=F.lit('"x"'), page=F.col("b")).alias("b")).collect()
    assert all(r.a == r.b and len(r.a) == 64 for r in hashes)
    by_content = {}
    for r in hashes:
        by_content.setdefault(r.a, set()).add(json.dumps(values[r.i], sort_keys=True))
    assert all(len(v) == 1 for v in by_content.values())
    assert len(by_content) == len({json.dumps(v, sort_keys=True) for v in values})


def test_signatures_and_restoring(spark):
    texts = [None, "[]", " [ ] ", '[{"b":1,"a":2}]', '[{"a": 2, "b": 1}]', "no json"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "s string").select(K.steps_signature(F.col("s"))).collect()]
    assert got == ["", "", "", '[{"a":2,"b":1}]', '[{"a":2,"b":1}]', ""]
    rows = [(1, "h", "review", "h"), (2, "h", "review", "h"), (1, "", "review", ""), (1, "h", "nowhere", "h"), (1, "h", "done", "g"), (None, None, None, None), (1, "h", "plan", None)]
    df = spark.createDataFrame(rows, "v int, s string, n string, c string")
    got = [r[0] for r in df.select(K.restorable(*map(F.col, "vsnc"))).collect()]
    assert got == [True, False, False, False, False, False, False]
    assert spark.range(1).select(K.content_hash(a=F.lit("{"))).first()[0] is None


def test_kept_pages(spark):
    rnd = random.Random(5)
    rows, want = [], set()
    for plan in range(60):
        n = 50 if plan % 20 == 7 else rnd.randint(1, 15)
        own = [(f"p{i}", sorted({f"p{rnd.randint(0, n if rnd.random() < 0.1 else max(i, 1))}" for _ in range(rnd.randint(0, 2))}), rnd.choice([True] * 9 + [False, None])) for i in range(n)]
        rows += [(plan, *r) for r in own]
        kept = {p: needs for p, needs, holds in own if holds}
        while gone := [p for p, needs in kept.items() if not set(needs) <= kept.keys()]:
            for p in gone:
                del kept[p]
        want |= {(plan, p) for p in kept}
    pages = spark.createDataFrame(rows, "plan_id long, page_id string, prerequisites array<string>, holds boolean")
    got = [tuple(r) for r in K.kept_pages(pages).collect()]
    assert sorted(got) == sorted(want) and len(got) > 100
    assert any(p % 20 == 7 for p, _ in got)
    assert K.kept_pages(pages.limit(0)).count() == 0
