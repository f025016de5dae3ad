"""Folds over arrays as Column expressions, for what follows an order and has a small state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space that is cut from the ends of texts, as Unicode has it.
BLANKS = "\t\n\v\f\r \x85\xa0                　"
#: Entries of a list under construction that are moved at once.
_BLOCK = 256


def trimmed(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once.

    An aggregate over nothing binds its start and finishes. An array of one transformed would do too, but
    taking its element works out the type of the whole body for every value, and the result is copied.
    """
    return F.aggregate(F.array(), value, lambda bound, _: bound, body)


def emitted(
    items: Column,
    state: str,
    start: Column,
    kind: str,
    step: Callable[[Column, Column], tuple[Column, Column]],
    last: Callable[[Column], Column] | None = None,
) -> Column:
    """The entries of type ``kind`` that a fold with a state of type ``state`` gives.

    ``step(state, item)`` is the next state and an array of entries; ``last`` gives those after the
    last item. The list is kept in blocks, so a step does not copy all that was given before.
    """
    whole = f"struct<state: {state}, blocks: array<array<{kind}>>, part: array<{kind}>>"

    def move(held: Column, item: Column) -> Column:
        def put(new: Column) -> Column:
            full = F.size(new["part"]) >= _BLOCK
            none = F.array().cast(f"array<{kind}>")
            blocks = F.when(full, F.concat(held["blocks"], F.array(new["part"]))).otherwise(held["blocks"])
            return F.struct(
                new["state"].alias("state"), blocks.alias("blocks"), F.when(full, none).otherwise(new["part"]).alias("part")
            ).cast(whole)

        after, out = step(held["state"], item)
        return let(F.struct(after.cast(state).alias("state"), F.concat(held["part"], out.cast(f"array<{kind}>")).alias("part")), put)

    def finish(held: Column) -> Column:
        parts = [F.flatten(held["blocks"]), held["part"]]
        return F.concat(*parts, *([last(held["state"]).cast(f"array<{kind}>")] if last else []))

    none = F.array().cast(f"array<{kind}>")
    zero = F.struct(
        start.cast(state).alias("state"), F.array().cast(f"array<array<{kind}>>").alias("blocks"), none.alias("part")
    ).cast(whole)
    return F.aggregate(items, zero, move, finish)
