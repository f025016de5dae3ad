"""Fill-in-middle transformation: a parallel automaton scan over chunks of a text.

1. An automaton cuts texts into units (lines or paragraphs), another one finds the
   marks. A chunk is scanned without knowing the state it is entered in: it gives
   the state after it, and the number of units that begin in it, for every state
   before it. Inside a chunk such functions are composed in pairs, level by level.
2. Texts of one chunk are done where they stand. The chunks of longer ones are dealt
   to all tasks; the small functions of a text's chunks are then composed in order,
   which gives each chunk its entry state and the number of units before it.
3. A cut after k units is found by these numbers: first the chunk, then a descent
   through the levels inside it. No other chunk is read for it.
4. The text is cut twice, at places that hashes of the id choose, and put together as
   prefix, suffix, middle (``psm``) or suffix, prefix, middle (``spm``).

Defined cases: null texts are empty ones; an empty text, or one that holds a mark, is
``plain`` and stays as it is. A null id is hashed as an empty string. Rows that
repeat an id each get their row, with the same hashes. An empty table gives an empty one. Columns
of the input that have the name of a new one give way; all others stay.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import deque
from collections.abc import Iterator, Sequence
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from heronmill.llm.shared import arrow_pass, new_name

MARKS = ("<P>", "<S>", "<M>")
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")
#: What one pass yields at once, in code points.
SLICE = 1 << 22

#: The state after a chunk, and the units begun in it, for every state before it.
Step = tuple[np.ndarray, np.ndarray]


class Automaton:
    """``table[c][s]`` is the state after a character of class ``c``, ``begins[c][s]`` is 1 where it begins a unit.

    State 0 is the first one; characters outside ``classes`` are of class 0.
    """

    def __init__(self, classes: dict[str, int], table: Sequence[Sequence[int]], begins: Sequence[Sequence[int]]):
        top = max(map(ord, classes), default=0)
        self.top = top + 1
        self.lookup = np.zeros(top + 2, np.uint8)
        for c, own in classes.items():
            self.lookup[ord(c)] = own
        self.table = np.array(table, np.intp)
        self.begins = np.array(begins, np.int64)
        # A second character of such a class changes nothing: a run of them is one step.
        again = np.take_along_axis(self.table, self.table, 1)
        more = np.take_along_axis(self.begins, self.table, 1)
        self.idle = (again == self.table).all(1) & (more == 0).all(1)

    def levels(self, piece: str) -> tuple[np.ndarray, list[Step]]:
        """Places of the steps, and the functions of 1, 2, 4, ... steps, up to the one of the whole piece."""
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), "<u4")
        kind = self.lookup[np.minimum(codes, self.top)]
        new = ~self.idle[kind]
        new[:1] = True
        new[1:] |= kind[1:] != kind[:-1]
        at = np.flatnonzero(new)
        to, n = self.table[kind[at]], self.begins[kind[at]]
        if not len(at):
            to, n = np.arange(self.table.shape[1])[None], np.zeros((1, self.table.shape[1]), np.int64)
        out = [(to, n)]
        states = to.shape[1]
        row = np.arange(0, len(to) * states, 2 * states)[:, None]
        while len(to) > 1:
            half = len(to) // 2
            then = to[: 2 * half : 2] + (row[:half] + states)  # where the second of each pair is entered
            both = to.ravel()[then], n[: 2 * half : 2] + n.ravel()[then]
            if len(to) % 2:  # the last one has no partner
                both = np.concatenate((both[0], to[-1:])), np.concatenate((both[1], n[-1:]))
            to, n = both
            out.append(both)
        return at, out

    def scan(self, piece: str) -> Step:
        to, n = self.levels(piece)[1][-1]
        return to[0], n[0]

    def place(self, piece: str, state: int, k: int) -> int:
        """Where unit ``k`` (from 0) of those that begin in ``piece`` begins, if it is entered in ``state``."""
        at, levels = self.levels(piece)
        i = 0
        for to, n in reversed(levels[:-1]):
            i *= 2
            if k >= n[i, state]:
                k -= n[i, state]
                state = to[i, state]
                i += 1
        return int(at[i])


def lines() -> Automaton:
    r"""Units ``[^\n]*\n|[^\n]+``; states: at a line's beginning, inside."""
    return Automaton({"\n": 1}, [[1, 1], [0, 0]], [[1, 0], [1, 0]])


def paragraphs() -> Automaton:
    """A unit ends with a run of two or more line ends; states: beginning, inside, after one line end, after more."""
    return Automaton({"\n": 1}, [[1, 1, 1, 1], [2, 2, 3, 3]], [[1, 0, 0, 1], [1, 0, 0, 0]])


def containing(words: Sequence[str]) -> Automaton:
    """Counts the places where one of these words ends."""
    nodes: list[dict[str, int]] = [{}]
    ends = [0]
    for word in words:
        at = 0
        for c in word:
            if c not in nodes[at]:
                nodes[at][c] = len(nodes)
                nodes.append({})
                ends.append(0)
            at = nodes[at][c]
        ends[at] = 1
    letters = {c: k for k, c in enumerate(sorted(set("".join(words))), 1)}
    table = np.zeros((len(letters) + 1, len(nodes)), int)
    back = [0] * len(nodes)
    queue = deque([0])
    while queue:
        at = queue.popleft()
        ends[at] |= ends[back[at]]
        for c, k in letters.items():
            fall = int(table[k, back[at]]) if at else 0
            if c in nodes[at]:
                child = nodes[at][c]
                back[child] = fall
                table[k, at] = child
                queue.append(child)
            else:
                table[k, at] = fall
    return Automaton(letters, table, np.array(ends)[table])


UNITS = {"line": lines, "paragraph": paragraphs}


def composed(steps: Sequence[tuple[Sequence[int], Sequence[int]]]) -> tuple[list[int], list[int], int]:
    """Entry state of each chunk, units that begin before it, and their number in all."""
    state, n = 0, 0
    entry, before = [], []
    for to, count in steps:
        entry.append(state)
        before.append(n)
        n += int(count[state])
        state = int(to[state])
    return entry, before, n


def offset(text: str, k: int, unit: Automaton, chunk: int, entry: Sequence[int], before: Sequence[int], n: int) -> int:
    """Where the first ``k`` units end."""
    if k >= n:
        return len(text)
    i = bisect_right(before, k) - 1  # of chunks where no unit begins, the next one counts
    return i * chunk + unit.place(text[i * chunk : (i + 1) * chunk], entry[i], k - before[i])


def hashes(ident: int | str | None, seed: int) -> list[int]:
    """The first four groups of eight hex digits."""
    digest = sha256(f"{seed}:{'' if ident is None else ident}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


@cache
def automata(unit: str, marks: tuple[str, ...]) -> tuple[Automaton, Automaton]:
    return UNITS[unit](), containing(marks)


def long_plans(docs: DataFrame, key: str, text_col: str, unit: str, marks: tuple[str, ...], chunk: int) -> DataFrame:
    """(key, entry, before, n, marked) of texts of several chunks, which are dealt to all tasks.

    A text has 2^31 bytes at most, so its list has some thousands of small rows at most.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for ident, text in zip(*(c.to_pylist() for c in batch.columns)):
                for part, at in enumerate(range(0, len(text), chunk)):
                    yield {"key": [ident], "part": [part], "piece": [text[at : at + chunk]]}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        units, found = automata(unit, marks)
        for batch in batches:
            steps = [(units.scan(p), found.scan(p)) for p in batch.column(2).to_pylist()]
            yield {
                "key": batch.column(0), "part": batch.column(1),
                "to": [s[0][0] for s in steps], "n": [s[0][1] for s in steps],
                "mark_to": [s[1][0] for s in steps], "mark_n": [s[1][1] for s in steps],
            }

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for ident, steps in zip(*(c.to_pylist() for c in batch.columns)):
                entry, before, n = composed([(s["to"], s["n"]) for s in steps])
                marked = composed([(s["mark_to"], s["mark_n"]) for s in steps])[2] > 0
                yield {"key": [ident], "entry": [entry], "before": [before], "n": [n], "marked": [marked]}

    pieces = arrow_pass(docs.select(key, text_col).distinct(), "key string, part int, piece string", cut)
    steps = arrow_pass(
        pieces.repartition("key", "part"),
        "key string, part int, to array<int>, n array<long>, mark_to array<int>, mark_n array<long>",
        scan,
    )
    lists = steps.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("part", "to", "n", "mark_to", "mark_n"))).alias("steps")
    )
    return arrow_pass(lists, "key string, entry array<int>, before array<long>, n long, marked boolean", compose)


def fill_middle(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    unit: str = "line",
    fim_percent: int = 100,
    spm_percent: int = 50,
    seed: int = 7,
    chunk: int = 1 << 20,
    marks: tuple[str, str, str] = MARKS,
) -> DataFrame:
    """``docs`` with ``n`` units, ``form``, ``prefix_chars``, ``middle_chars`` and the transformed ``output``."""
    docs = docs.drop(*ADDED)
    key = new_name(docs, "_key")
    plan = new_name(docs, "_plan")
    docs = docs.withColumn(text_col, F.coalesce(text_col, F.lit("")))
    # So many bytes hold as many code points at most: such texts are one chunk.
    several = F.octet_length(F.col(f"`{text_col}`")) > chunk
    ident = F.concat(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(":"), F.col(f"`{text_col}`"))
    long = docs.where(several).withColumn(key, F.sha2(ident, 256))
    plans = long_plans(long, key, text_col, unit, marks, chunk).select(
        F.col("key").alias(new_name(long, "_of")), F.struct("entry", "before", "n", "marked").alias(plan)
    )
    whole = docs.where(~several).withColumn(plan, F.lit(None).cast(plans.schema[plan].dataType))
    planned = long.join(plans, F.col(key) == F.col(plans.columns[0])).select(*(F.col(f"`{c}`") for c in whole.columns))
    names = docs.columns
    schema = StructType(docs.schema.fields)
    for name in ADDED:
        schema = schema.add(name, StringType() if name in ("form", "output") else LongType())

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        units, found = automata(unit, marks)

        def row(ident: int | str | None, text: str, given: dict | None) -> tuple:
            if given is None:
                entry, before, n = composed([units.scan(text)])
                marked = found.scan(text)[1][0] > 0
            else:
                entry, before, n, marked = given["entry"], given["before"], given["n"], given["marked"]
            h1, h2, h3, h4 = hashes(ident, seed)
            if not text or marked or h3 % 100 >= fim_percent:
                return n, "plain", None, None, text
            first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
            a, b = (offset(text, k, units, chunk, entry, before, n) for k in (first, last))
            prefix, middle, suffix = text[:a], text[a:b], text[b:]
            if h4 % 100 < spm_percent:
                return n, "spm", a, b - a, f"{marks[1]}{suffix}{marks[0]}{prefix}{marks[2]}{middle}"
            return n, "psm", a, b - a, f"{marks[0]}{prefix}{marks[1]}{suffix}{marks[2]}{middle}"

        for batch in batches:
            idents, plans = batch.column(names.index(id_col)), batch.column(len(names)).to_pylist()
            texts = batch.column(names.index(text_col))
            rows: list[tuple] = []
            held = begun = 0
            for i, given in enumerate(plans):
                rows.append(row(idents[i].as_py(), texts[i].as_py(), given))
                held += len(rows[-1][4])
                if held >= SLICE or i == len(plans) - 1:
                    part = batch.slice(begun, len(rows))
                    own = {c: part.column(k) for k, c in enumerate(names)}
                    yield own | dict(zip(ADDED, map(list, zip(*rows))))
                    rows, held, begun = [], 0, i + 1

    return arrow_pass(whole.unionByName(planned), schema, put_together)


def restored(output: str, form: str, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that ``output`` was made of, exactly."""
    pattern = "|".join(rf"\Q{m}\E" for m in marks)
    parts = F.split(F.col(output), pattern, -1)
    return (
        F.when(F.col(form) == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(F.col(form) == "spm", F.concat(parts[2], parts[3], parts[1]))
        .otherwise(F.col(output))
    )


def digest(docs: DataFrame, **options) -> DataFrame:
    """Rows of query op12."""
    return fill_middle(docs.select("doc_id", "text"), **options).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored("output", "form"), 256).alias("restored_sha256"),
    )
