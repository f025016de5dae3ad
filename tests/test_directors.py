"""Plans and decisions against plain functions over lists."""

import random

from pyspark.sql import functions as F

from heronmill.operators import directors as D
from heronmill.operators.pages import levels, levels_by_rounds

PEOPLE = ["teacher", "tom", "ann", "bob"]


def normal(plan, people, teachers, many, trivial):
    mode, length, kind, safety, speakers = plan
    own = list(dict.fromkeys(s for s in speakers or [] if s is not None))
    fallback = ("reply", "normal", "unknown", "allow", [next((p for p in people if p in teachers), people[0])] if people else [])
    if not people or mode not in D.MODES or (mode != "round" and set(own) - set(people)):
        return fallback
    own = list(people) if mode == "round" else own
    if not own and (mode == "redirect" or safety == "refuse"):
        own = people[:1]
    if not own:
        return fallback
    if safety == "refuse":
        mode, length = "reply", "brief"
    length = length if length in D.LENGTHS else "normal"
    kind = kind if kind in D.TYPES else "unknown"
    safety = "refuse" if safety == "refuse" else "allow"
    own = own[:1] if mode in ("reply", "clarify") else own[:3] if mode == "discussion" else own
    if many and safety != "refuse" and mode not in ("redirect", "round", "clarify"):
        if kind == "simple":
            mode, own = "reply", own[:1]
        elif mode == "reply" and kind == "multi_view" and len(people) >= 2 and not trivial:
            mode = "discussion"
            own = list(dict.fromkeys([*own[:2], *people]))[:2]
    return mode, length, kind, safety, own


def decide(plan, people, turns, most):
    mode, speakers = plan[0], [s for s in plan[4] if s in people]
    last = turns[-1] if turns else None
    if last and last[2] == "ask_user":
        return None, False, "waiting", None
    if not speakers:
        return None, False, "completed", None
    lead, spoken = speakers[0], [t[1] for t in turns]
    if not turns:
        return lead, False, None, "lead"
    if mode in ("reply", "clarify", "redirect"):
        return None, False, "completed", None
    turn = len(turns) + 1
    silent = [s for s in speakers if s not in spoken]
    if mode == "discussion":
        if spoken.count(lead) > 1 or (last[2] == "finish" and last[1] == lead):
            return None, False, "completed", None
        if turn > most:
            return None, False, "max_turns", None
        if (turn == most and turn > 2) or last[2] == "finish":
            return lead, True, None, "closing"
        if last[3] in silent:
            return last[3], False, None, "preferred"
    if silent:
        return silent[0], False, None, "plan"
    if mode == "discussion" and len(speakers) > 1:
        return lead, True, None, "closing"
    return None, False, "completed", None


def test_plans_and_decisions(spark):
    rnd = random.Random(12)
    cases, turns = [], []
    for k in range(400):
        people = rnd.choice([PEOPLE, PEOPLE[1:], ["tom"], [], ["ann", "teacher"]])
        plan = (
            rnd.choice([*D.MODES, "discussion", "discussion", "x", None]), rnd.choice([*D.LENGTHS, "?", None]), rnd.choice([*D.TYPES, None]),
            rnd.choice(["allow", "allow", "refuse", None]), rnd.choice([None, [], rnd.choices([*PEOPLE, None], k=rnd.randint(1, 5)), [*people, "zoe"], people[::-1]]),
        )
        cases.append((k, plan, people, rnd.random() < 0.5, rnd.random() < 0.2))
        turns += [(k, t, rnd.choice(people or PEOPLE), rnd.choice(["switch_agent"] * 6 + ["finish", "ask_user", None]), rnd.choice([*PEOPLE, None])) for t in range(rnd.randint(0, 8))]
    schema = f"conv long, raw {D.PLAN}, participants array<string>, many boolean, trivial boolean"
    rows = spark.createDataFrame(cases, schema)
    teachers = F.array(F.lit("teacher"))
    plan = D.response_plan(F.col("raw"), F.col("participants"), teachers, F.col("many"), F.col("trivial"))
    plans = rows.select("conv", plan.alias("plan"), "participants")
    got = {r.conv: tuple(r.plan) for r in plans.collect()}
    want = {k: normal(p, people, ["teacher"], many, trivial) for k, p, people, many, trivial in cases}
    assert got == want
    log = spark.createDataFrame(turns, "conv long, turn int, speaker string, action string, preferred string").repartition(3)
    found = {(r.conv, r.taken): tuple(r)[2:] for r in D.decisions(log, plans, "conv", 5).collect()}
    for k, _, people, *_ in cases:
        own = [t[1:] for t in turns if t[0] == k]
        for n in range(len(own) + 1):
            assert found.pop((k, n)) == decide(want[k], people, own[:n], 5)
    assert not found


def test_most_turns(spark):
    rows = spark.createDataFrame([(None,), (0,), (1,), (20,), (21,), (-1,)], "n int")
    assert [r[0] for r in rows.select(D.most_turns(F.col("n"))).collect()] == [6, 6, 1, 20, None, None]


def test_levels_of_small_and_large_plans(spark):
    rnd = random.Random(1)
    rows = []
    for plan in range(30):
        n = 40 if plan == 3 else rnd.randint(1, 15)
        for i in range(n):
            rows.append((plan, f"p{i}", sorted({f"p{rnd.randint(0, max(0, i - 1) if rnd.random() < 0.9 else n)}" for _ in range(rnd.randint(0, 2))}) if i else []))
    pages = spark.createDataFrame(rows, "plan_id long, page_id string, prerequisites array<string>")
    got = sorted(map(tuple, levels(pages).collect()))
    assert got == sorted(map(tuple, levels_by_rounds(pages).collect())) and len(got) > 100
    assert levels(pages.limit(0)).count() == 0
