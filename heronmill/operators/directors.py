"""Who answers a question: response plans made valid, and the next speaker after every turn under a plan.

A plan is a struct of mode, length, question_type, safety and speakers. The state after a turn is what came
before it in its conversation (turns taken, last speaker and action, who has spoken, how often the lead has), so the decisions
of all turns are running windows over (conversation, turn), and one decision is a function of that state alone:
a stream that keeps the state decides by the same function.

Defined cases: null speakers and those that repeat count once or not at all; conversations without participants get the
fault ``no participants`` and no speaker; turns that repeat a number are taken in order of their speakers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODES = ("reply", "clarify", "discussion", "round", "redirect")
LENGTHS = ("brief", "normal", "detailed", "one_sentence")
TYPES = ("simple", "multi_view", "unclear")
PLAN = "struct<mode: string, length: string, question_type: string, safety: string, speakers: array<string>>"
DECISION = "struct<speaker: string, closing: boolean, stop_reason: string, reason: string>"
DEFAULT_TURNS, MOST_TURNS = 6, 20
MOST_SPEAKERS = 3


def most_turns(value: Column) -> Column:
    """Turns that a discussion may take: the default for none, null beyond the range."""
    return F.when(F.coalesce(value, F.lit(0)) == 0, DEFAULT_TURNS).when(value.between(1, MOST_TURNS), value)


def known_speakers(speakers: Column) -> Column:
    return F.array_distinct(F.array_compact(F.coalesce(speakers, F.array().cast("array<string>"))))


def plan_fault(plan: Column, participants: Column) -> Column:
    """Why a plan cannot be followed, or null."""
    speakers = known_speakers(plan["speakers"])
    unknown = F.array_except(speakers, participants)
    needs_none = (plan["mode"] == "redirect") | F.coalesce(plan["safety"] == "refuse", F.lit(False)) | (plan["mode"] == "round")
    return (
        F.when(F.coalesce(F.size(participants), F.lit(0)) <= 0, "no participants")
        .when(~F.coalesce(plan["mode"].isin(*MODES), F.lit(False)), "unknown mode")
        .when((plan["mode"] != "round") & (F.size(unknown) > 0), F.concat(F.lit("unknown speaker "), F.get(unknown, F.lit(0))))
        .when((F.size(speakers) == 0) & ~needs_none, "no speaker")
    )


def fallback_plan(participants: Column, teachers: Column) -> Column:
    """A reply by the first teacher, else by the first participant."""
    first = F.coalesce(F.get(F.array_intersect(participants, teachers), F.lit(0)), F.get(participants, F.lit(0)))
    speakers = F.when(first.isNull(), F.array().cast("array<string>")).otherwise(F.array(first))
    return F.struct(F.lit("reply"), F.lit("normal"), F.lit("unknown"), F.lit("allow"), speakers).cast(PLAN)


def normal_plan(plan: Column, participants: Column) -> Column:
    """A plan without a fault made valid: known values, distinct speakers, as many as its mode takes."""
    own = known_speakers(plan["speakers"])
    refused = F.coalesce(plan["safety"] == "refuse", F.lit(False))
    mode = F.when(refused, "reply").otherwise(plan["mode"])
    everyone = F.when(plan["mode"] == "round", participants).otherwise(own)
    someone = F.when(F.size(everyone) == 0, F.slice(participants, 1, 1)).otherwise(everyone)
    most = F.when(mode.isin("reply", "clarify"), 1).when(mode == "discussion", MOST_SPEAKERS).otherwise(F.size(someone))
    return F.struct(
        mode,
        F.when(refused, "brief").when(plan["length"].isin(*LENGTHS), plan["length"]).otherwise("normal"),
        F.when(plan["question_type"].isin(*TYPES), plan["question_type"]).otherwise("unknown"),
        F.when(refused, "refuse").otherwise("allow"),
        F.slice(someone, F.lit(1), most),
    ).cast(PLAN)


def promoted_plan(plan: Column, trivial: Column, participants: Column) -> Column:
    """With many voices asked for: questions of many views get two speakers, simple ones one."""
    fixed = (plan["safety"] == "refuse") | plan["mode"].isin("redirect", "round", "clarify")
    two = F.slice(F.array_distinct(F.concat(F.slice(plan["speakers"], 1, 2), participants)), 1, 2)
    more = (plan["mode"] == "reply") & (plan["question_type"] == "multi_view") & (F.size(participants) >= 2) & ~trivial
    new = lambda mode, speakers: F.struct(mode, plan["length"], plan["question_type"], plan["safety"], speakers).cast(PLAN)
    return (
        F.when(fixed, plan)
        .when(plan["question_type"] == "simple", new(F.lit("reply"), F.slice(plan["speakers"], 1, 1)))
        .when(more, new(F.lit("discussion"), two))
        .otherwise(plan)
    )


def response_plan(raw: Column, participants: Column, teachers: Column, many_voices: Column, trivial: Column) -> Column:
    """The plan to follow: the raw one made valid and promoted, or the fallback."""
    valid = normal_plan(raw, participants)
    told = F.when(many_voices, promoted_plan(valid, trivial, participants)).otherwise(valid)
    return F.when(plan_fault(raw, participants).isNull(), told).otherwise(fallback_plan(participants, teachers))


def decision(plan: Column, participants: Column, taken: Column, last: Column, action: Column, preferred: Column, spoken: Column, lead_turns: Column, most: int) -> Column:
    """What follows a state: the next speaker, or why the discussion stops.

    ``taken`` turns were taken, the last one by ``last`` with ``action`` and the wish for ``preferred``; ``spoken``
    are all who spoke, and the plan's first speaker did so ``lead_turns`` times. An action is ``ask_user``, ``finish`` or any other.
    """
    asked = F.array_intersect(plan["speakers"], participants)
    lead = F.get(asked, F.lit(0))
    silent = F.array_except(asked, spoken)
    turn = taken + 1

    def goes(speaker: Column, reason: str, closing: bool = False) -> Column:
        return F.struct(speaker, F.lit(closing), F.lit(None).cast("string"), F.lit(reason)).cast(DECISION)

    def stops(reason: str) -> Column:
        return F.struct(F.lit(None).cast("string"), F.lit(False), F.lit(reason), F.lit(None).cast("string")).cast(DECISION)

    finished = F.coalesce(action == "finish", F.lit(False))
    talk = plan["mode"] == "discussion"
    return (
        F.when(F.coalesce(action == "ask_user", F.lit(False)), stops("waiting"))
        .when(lead.isNull(), stops("completed"))
        .when(taken == 0, goes(lead, "lead"))
        .when(plan["mode"].isin("reply", "clarify", "redirect"), stops("completed"))
        .when(talk & ((lead_turns > 1) | (finished & (last == lead))), stops("completed"))
        .when(talk & (turn > most), stops("max_turns"))
        .when(talk & (((turn == most) & (turn > 2)) | finished), goes(lead, "closing", True))
        .when(talk & F.array_contains(silent, preferred), goes(preferred, "preferred"))
        .when(F.size(silent) > 0, goes(F.get(silent, F.lit(0)), "plan"))
        .when(talk & (F.size(asked) > 1), goes(lead, "closing", True))
        .otherwise(stops("completed"))
    )


def decisions(turns: DataFrame, plans: DataFrame, key: str, most: int = DEFAULT_TURNS) -> DataFrame:
    """(key, taken, speaker, closing, stop_reason, reason): the decision before the first turn and after each.

    ``turns`` has (key, turn, speaker, action, preferred), ``plans`` one row (key, plan, participants) for each conversation.
    What is kept of a conversation is the set of its speakers and some numbers, so its turns stream through a task.
    """
    own = plans.select(key, "plan", "participants")
    lead = F.get(F.array_intersect(F.col("plan")["speakers"], F.col("participants")), F.lit(0))
    order = Window.partitionBy(key).orderBy("turn", "speaker").rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.select(key, "turn", "speaker", "action", "preferred").join(own, key)
    seen = rows.withColumns(
        {
            "taken": F.count("*").over(order).cast("int"),
            "spoken": F.collect_set("speaker").over(order),
            "lead_turns": F.count_if(F.col("speaker") == lead).over(order),
        }
    )
    none = F.lit(None).cast("string")
    start = own.withColumns(
        {"taken": F.lit(0), "speaker": none, "action": none, "preferred": none, "spoken": F.array().cast("array<string>"), "lead_turns": F.lit(0).cast("long")}
    )
    every = seen.drop("turn").unionByName(start)
    found = decision(*(F.col(c) for c in ("plan", "participants", "taken", "speaker", "action", "preferred", "spoken", "lead_turns")), most)
    return every.select(key, "taken", found.alias("d")).select(key, "taken", "d.*")
