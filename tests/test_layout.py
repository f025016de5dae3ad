"""Covered blocks against a loop over all pairs, with both conditions of the rule."""

import random

from pyspark.sql import functions as F

from heronmill.operators import layout as L

SCHEMA = "page long, id long, x0 double, y0 double, x1 double, y1 double, text string"


def ratio(b, t):
    w, h = min(b[4], t[4]) - max(b[2], t[2]), min(b[5], t[5]) - max(b[3], t[3])
    area = (b[4] - b[2]) * (b[5] - b[3])
    return w * h / area if w > 0 and h > 0 and area > 0 else 0.0


def takes(t, b):
    if b[0] is None or b[0] != t[0] or None in b[2:6] or None in t[2:6] or not (t[6] or "").strip():
        return False
    x, y = (b[2] + b[4]) / 2, (b[3] + b[5]) / 2
    return (t[2] <= x <= t[4] and t[3] <= y <= t[5]) or ratio(b, t) >= 0.5


def boxes(rnd, n, wide):
    out = []
    for i in range(n):
        x, y = rnd.choice([0.0, 75.0, 150.0, 300.0, rnd.uniform(-200, 900)]), rnd.choice([0.0, 150.0, rnd.uniform(-200, 900)])
        w, h = rnd.choice([0.0, 50.0, 150.0, rnd.uniform(0, wide)]), rnd.choice([0.0, 20.0, 150.0, rnd.uniform(0, wide)])
        out.append([rnd.choice([1, 1, 1, 2, 3, None]), i, x, y, x + w, y + h, rnd.choice(["t", " u ", "", None, "v"])])
    for r in out[:: max(1, n // 5)]:
        r[rnd.randint(2, 5)] = None
    return out


def test_page_items(spark):
    rnd = random.Random(1)
    blocks, tables = boxes(rnd, 600, 200), boxes(rnd, 25, 5000) + boxes(rnd, 25, 300)
    blocks += blocks[:5]
    names = ("_id", "_page", "s", "mx", "_scale")
    made = [spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in names if c != "_id"}) for rows in (blocks, tables)]
    got = sorted(map(str, L.page_items(*made, "page", "id").collect()))
    assert len(got) == len([t for t in tables if (t[6] or "").strip()]) + len(
        want := [b for b in blocks if (b[6] or "").strip() and not any(takes(t, b) for t in tables)]
    )
    kept = sorted((b[1], b[6].strip()) for b in want)
    assert sorted((r.id, r.text) for r in L.page_items(*made, "page", "id").where("NOT is_table").collect()) == kept
    assert len(kept) < len(blocks) - 100


def test_page_texts_in_order(spark):
    blocks = [[1, 0, 0.0, 0.0, 10.0, 10.0, "title"], [1, 1, 0.0, 50.0, 10.0, 60.0, "cell"], [1, 2, 0.0, 90.0, 10.0, 99.0, "end"], [2, 3, 0.0, 0.0, 1.0, 1.0, "x"]]
    tables = [[1, 9, 0.0, 45.0, 20.0, 70.0, "| a | b |"]]
    made = [spark.createDataFrame(rows, SCHEMA) for rows in (blocks, tables)]
    got = {r.page: (r.n_tables, r.text) for r in L.page_texts(L.page_items(*made, "page", "id"), "page", "id").collect()}
    assert got == {1: (1, "title\n\n| a | b |\n\nend"), 2: (0, "x")}
    none = made[1].limit(0)
    assert L.page_items(made[0], none, "page", "id").count() == 4
    assert L.page_items(made[0].limit(0), none, "page", "id").count() == 0
