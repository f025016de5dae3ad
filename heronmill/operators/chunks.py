"""Chunks of Markdown as a plan over the section tree.

A section that fits with all below it is one chunk. Of a larger one the own blocks are packed to a budget, and
what its parts give is joined to it: level by level from the deepest one up. Packing
and joining follow an order with a small state, so they are folds over the pieces of one section, or over the
groups of one parent; no group is larger than a text.

Chunks overlap: each begins with the end of the one before it, from a sentence's beginning on, if there is room.
Chunk contents have no headings; these stand in their own columns.

Defined cases: null and blank texts give no chunks; rows that repeat an id each give theirs, numbered from 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heronmill.functions import text as X
from heronmill.functions.folds import emitted, let, trimmed
from heronmill.operators.sections import LEVELS, blocks_of, path_of

MOST, LEAST, OVERLAP = 800, 120, 120
#: A document with more chunks is refused by the ingest.
MOST_CHUNKS = 600
#: Columns for headings and paths have so many characters.
MOST_HEADING = 300
ENDS = X.SENTENCE_ENDS.replace("\n", r"\n")

PIECE = "struct<text: string, gap: string>"
#: ``text`` is the content: the seed, an empty line and the body, without white space at the ends.
CHUNK = "struct<heading: string, path: string, seed: string, body: string, text: string>"
CHUNKS = f"array<{CHUNK}>"
#: Chunks with the place of their first block and the sections that they have still to be joined at, from the top.
GROUP = f"struct<at: bigint, chain: array<bigint>, chunks: {CHUNKS}>"
GAP = "\n\n"


@dataclass(frozen=True)
class Limits:
    """Sizes in characters, made consistent."""

    most: int = MOST
    least: int = LEAST
    overlap: int = OVERLAP

    def __post_init__(self):
        most = self.most if self.most > 0 else MOST
        object.__setattr__(self, "most", most)
        object.__setattr__(self, "least", min(self.least if self.least > 0 else LEAST, most))
        object.__setattr__(self, "overlap", min(self.overlap if self.overlap > 0 else OVERLAP, most // 2))

    @property
    def fill(self) -> int:
        """What a chunk may hold besides its overlap."""
        return self.most - self.overlap if self.most > self.overlap else self.most


def none_of(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def content(seed: Column, body: Column) -> Column:
    return trimmed(F.when(seed == "", body).otherwise(F.concat(seed, F.lit(GAP), body)))


def chunk_of(heading: Column, path: Column, seed: Column, body: Column) -> Column:
    own = F.struct(heading.alias("heading"), path.alias("path"), seed.alias("seed"), body.alias("body"))
    return let(own, lambda c: F.struct(c["heading"], c["path"], c["seed"], c["body"], content(c["seed"], c["body"])).cast(CHUNK))


def overlap_of(text: Column, room: Column, limits: Limits) -> Column:
    """The end of a text that starts the next chunk: from behind a sentence's end, if there is one."""
    tail = F.right(text, F.least(F.lit(limits.overlap), room))
    from_end = trimmed(F.regexp_extract(tail, f"(?s)^[^{ENDS}]*[{ENDS}](.*)$", 1))
    return F.when((room > 0) & (F.char_length(text) > limits.overlap), from_end).otherwise("")


def hard_pieces(sentence: Column, most: int) -> Column:
    """A sentence without an end inside, cut at a fixed size."""
    bare = F.regexp_replace(sentence, "\n$", "")
    count = F.ceil(F.char_length(bare) / most).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda k: F.substr(bare, k * most + 1, F.lit(most)))


def split_block(block: Column, limits: Limits) -> Column:
    """A block as texts that fit: whole, or sentences packed together; whole blocks may have twice the size."""
    text = block["text"]
    size = F.char_length(text)
    # What is left if it fits, else the longest row of sentences that does, else a sentence that is too long.
    rows = F.regexp_extract_all(
        text, F.lit(f"(?s).{{1,{limits.fill}}}\\z|.{{0,{limits.fill - 1}}}[{ENDS}]|[^{ENDS}]*+[{ENDS}]?+"), F.lit(0)
    )
    each = F.transform(
        F.filter(rows, lambda s: s != ""),
        lambda s: F.when(F.char_length(s) > limits.fill, hard_pieces(s, limits.fill)).otherwise(F.array(s)),
    )
    cut = F.flatten(each)
    fits = (size <= limits.fill) | (block["whole"] & (size <= 2 * limits.most))
    return F.filter(F.when(fits, F.array(text)).otherwise(cut), lambda t: trimmed(t) != "")


def pieces_of(blocks: Column, limits: Limits) -> Column:
    """Texts with the gap before them: an empty line between blocks, nothing inside of one."""
    each = F.transform(
        blocks,
        lambda b, i: F.transform(
            split_block(b, limits),
            lambda t, k: F.struct(t.alias("text"), F.when((i > 0) & (k == 0), F.lit(GAP)).otherwise("").alias("gap")),
        ),
    )
    return F.flatten(each)


def packed(pieces: Column, heading: Column, path: Column, limits: Limits) -> Column:
    """Pieces in order as chunks: filled, overlapping, and without a short end."""
    own = "struct<body: string, gap: string, size: int>"

    def fill(held: Column, p: Column) -> tuple[Column, Column]:
        gap = F.when(held["body"].isNull(), F.lit("")).otherwise(p["gap"])
        size = held["size"] + F.char_length(gap) + F.char_length(p["text"])
        over = held["body"].isNotNull() & (size > limits.fill)
        fresh = F.struct(p["text"].alias("body"), p["gap"].alias("gap"), F.char_length(p["text"]).alias("size"))
        joined = F.struct(F.concat(held["body"], gap, p["text"]).alias("body"), held["gap"].alias("gap"), size.alias("size"))
        after = F.when(over | held["body"].isNull(), fresh.cast(own)).otherwise(joined.cast(own))
        return after, F.when(over, F.array(held)).otherwise(none_of(own))

    empty = F.struct(F.lit(None).cast("string").alias("body"), F.lit("").alias("gap"), F.lit(0).alias("size"))
    bodies = emitted(pieces, own, empty, own, fill, lambda held: F.array(held))

    part = "struct<seed: string, body: string, gap: string, text: string>"

    def seed(before: Column, b: Column) -> tuple[Column, Column]:
        room = limits.most - F.char_length(trimmed(b["body"]))
        start = F.when(before["text"].isNull(), F.lit("")).otherwise(overlap_of(before["text"], room, limits))
        after = let(start, lambda s: F.struct(s, b["body"], b["gap"], content(s, b["body"])).cast(part))
        return after, F.when(before.isNotNull(), F.array(before)).otherwise(none_of(part))

    def ended(parts: Column) -> Column:
        n = F.size(parts)

        def two(last: Column) -> Column:
            other = F.get(parts, n - 2)
            return let(
                F.concat(other["body"], last["gap"], last["body"]),
                lambda body: F.struct(other["seed"], body, other["gap"], content(other["seed"], body)).cast(part),
            )

        def put(both: Column) -> Column:
            fits = F.char_length(both["text"]) <= limits.most + limits.overlap
            return F.when(fits, F.concat(F.slice(parts, F.lit(1), n - 2), F.array(both))).otherwise(parts)

        last = F.get(parts, n - 1)
        short = (n >= 2) & (F.char_length(last["text"]) < limits.least)
        return F.when(short, let(let(last, two), put)).otherwise(parts)

    seeded = emitted(
        F.filter(bodies, lambda b: b["body"].isNotNull()), part, F.lit(None), part, seed, lambda held: F.array(held)
    )
    own_chunk = lambda c: F.struct(heading, path, c["seed"], c["body"], c["text"]).cast(CHUNK)
    return F.filter(F.transform(let(seeded, ended), own_chunk), lambda c: c["text"] != "")


def joined(groups: Column, limits: Limits, inside: bool) -> Column:
    """Groups of chunks in order as one list.

    A group of one short chunk goes to the chunk before it where that fits; chunks of a section never go to a text
    without one (J06). Below a section, a short first group goes to the front of the next one (J07), and
    groups overlap like chunks.
    """

    def merge(held: Column, group: Column) -> tuple[Column, Column]:
        ends = F.struct(F.get(held, F.size(held) - 1).alias("last"), F.get(group, F.lit(0)).alias("one"))

        def tried(e: Column) -> Column:
            last, one = e["last"], e["one"]
            fits = (
                (F.size(group) == 1)
                & last.isNotNull()
                & ((last["path"] != "") | (one["path"] == ""))
                & (F.char_length(one["text"]) < limits.least)
                & (F.char_length(last["text"]) + len(GAP) + F.char_length(one["text"]) <= limits.most)
            )
            grown = chunk_of(last["heading"], last["path"], last["seed"], F.concat(last["body"], F.lit(GAP), one["text"]))
            return F.when(fits, grown)

        pair = f"struct<held: {CHUNKS}, out: array<{CHUNKS}>>"
        alone = F.struct(group, F.when(F.size(held) == 0, none_of(CHUNKS)).otherwise(F.array(held))).cast(pair)
        both = let(
            let(ends, tried),
            lambda grown: F.when(grown.isNull(), alone).otherwise(
                F.struct(F.concat(F.slice(held, F.lit(1), F.size(held) - 1), F.array(grown)), none_of(CHUNKS)).cast(pair)
            ),
        )
        return both["held"], both["out"]

    def headed(merged: Column) -> Column:
        def tried(e: Column) -> Column:
            small, target = e["small"], e["target"]
            fits = (
                (F.size(F.get(merged, F.lit(0))) == 1)
                & target.isNotNull()
                & (F.char_length(small) < limits.least)
                & (F.char_length(small) + len(GAP) + F.char_length(target["text"]) <= limits.most)
            )
            grown = chunk_of(target["heading"], target["path"], target["seed"], F.concat(small, F.lit(GAP), target["body"]))
            second = F.get(merged, F.lit(1))
            front = F.concat(F.array(grown), F.slice(second, F.lit(2), F.size(second)))
            return F.when(fits, F.concat(F.array(front), F.slice(merged, F.lit(3), F.size(merged)))).otherwise(merged)

        first = lambda k: F.get(F.get(merged, F.lit(k)), F.lit(0))
        return let(F.struct(first(0)["text"].alias("small"), first(1).alias("target")), tried)

    def seeded(before: Column, group: Column) -> tuple[Column, Column]:
        one = F.get(group, F.lit(0))
        seed = overlap_of(before["text"], limits.most - F.char_length(one["text"]), limits)
        start = F.when(before.isNull(), one).otherwise(chunk_of(one["heading"], one["path"], seed, one["body"]))
        both = let(
            F.concat(F.array(start), F.slice(group, F.lit(2), F.size(group))),
            lambda out: F.struct(F.element_at(out, -1).alias("last"), out.alias("out")),
        )
        return both["last"], both["out"]

    full = F.filter(groups, lambda g: F.size(g) > 0)
    merged = emitted(full, CHUNKS, none_of(CHUNK), CHUNKS, merge, lambda held: F.array(held))
    merged = F.filter(merged, lambda g: F.size(g) > 0)
    if not inside:
        return F.flatten(merged)
    return emitted(let(merged, headed), CHUNK, F.lit(None), CHUNK, seeded)


def met(groups: Column, depth: int, limits: Limits) -> Column:
    """Groups of one text in order, of which those that meet at a section of ``depth`` are one group.

    They stand next to each other, since a section is a stretch of its text.
    """

    def section(g: Column) -> Column:
        return F.when(F.size(g["chain"]) == depth, F.get(g["chain"], F.lit(depth - 1)))

    def runs(all_of: Column) -> Column:
        goes_on = lambda i: F.coalesce(section(F.get(all_of, i)) == section(F.get(all_of, i - 1)), F.lit(False))
        starts = F.filter(F.sequence(F.lit(0), F.size(all_of) - 1), lambda i: ~goes_on(i))

        def one(run: Column) -> Column:
            first = F.get(run, F.lit(0))
            chunks = joined(F.transform(run, lambda g: g["chunks"]), limits, True)
            chain = F.slice(first["chain"], F.lit(1), F.least(F.size(first["chain"]), F.lit(depth - 1)))
            return F.struct(first["at"], chain, F.when(F.size(run) == 1, first["chunks"]).otherwise(chunks)).cast(GROUP)

        def cut(at: Column) -> Column:
            upto = lambda k: F.coalesce(F.get(at, k + 1), F.size(all_of))
            return F.transform(at, lambda i, k: let(F.slice(all_of, i + 1, upto(k) - i), one))

        return F.when(F.exists(all_of, lambda g: F.size(g["chain"]) == depth), let(starts, cut)).otherwise(all_of)

    return let(groups.cast(f"array<{GROUP}>"), runs)


@cache
def steps(limits: Limits) -> tuple[Column, list[Column], Column]:
    """Chunks of a section's own ``blocks``, the ``groups`` of a text joined at each level from the deepest up, and all its chunks.

    They are the same for all tables, and large, so they are kept.
    """
    own = packed(pieces_of(F.col("blocks"), limits), F.col("heading"), F.col("path"), limits)
    levels = [met(F.col("groups"), depth, limits) for depth in reversed(LEVELS)]
    each = F.transform("groups", lambda g: g["chunks"])
    return own, levels, F.filter(joined(each, limits, False), lambda c: c["text"] != "")


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, limits: Limits | None = None) -> DataFrame:
    """(document_id, chunk_index, heading, section_path, content, character_count) of every text."""
    limits = limits or Limits()
    blocks = blocks_of(docs, id_col, text_col)
    above = F.col("above")
    fitting = F.filter(F.sequence(F.lit(1), F.size(above)), lambda k: F.element_at(above, k)["size"] <= limits.most)
    # The highest section that fits is one chunk; a block of none belongs to what its own section packs.
    top = F.get(F.when(F.size(above) > 0, fitting).otherwise(F.array().cast("array<int>")), F.lit(0))
    fits = F.when(F.size(above) == 0, F.col("size") <= limits.most).otherwise(top.isNotNull())
    home = F.slice(above, F.lit(1), F.coalesce(top, F.size(above)))
    rows = blocks.withColumns({"fits": fits, "home": home}).withColumns(
        {
            "node": F.coalesce(F.get("home", F.size("home") - 1)["unit"], F.lit(0)),
            "heading": F.coalesce(F.get("home", F.size("home") - 1)["title"], F.lit("")),
            "path": path_of(F.col("home")),
            # Sections at which the chunks are joined to others, from the top; packed blocks meet their section's parts there.
            "chain": F.transform(
                F.slice("home", F.lit(1), F.when(F.col("fits"), F.greatest(F.size("home") - 1, F.lit(0))).otherwise(F.size("home"))),
                lambda s: s["unit"],
            ),
        }
    )
    sections = rows.groupBy("row", "node", "fits").agg(
        F.first("document_id").alias("document_id"),
        F.min("unit").alias("at"),
        *(F.first(c).alias(c) for c in ("heading", "path", "chain")),
        F.array_sort(F.collect_list(F.struct("unit", "text", "whole"))).alias("blocks"),
    )
    whole = F.array(
        chunk_of(F.col("heading"), F.col("path"), F.lit(""), F.array_join(F.transform("blocks", lambda b: b["text"]), GAP))
    )
    own, levels, outer = steps(limits)
    groups = sections.select("row", "document_id", "at", "chain", F.when(F.col("fits"), whole).otherwise(own).alias("chunks"))
    # All levels are joined inside of one group for each text, which holds no more than that text.
    texts = groups.groupBy("row").agg(
        F.first("document_id").alias("document_id"), F.array_sort(F.collect_list(F.struct("at", "chain", "chunks"))).alias("groups")
    )
    for level in levels:
        texts = texts.withColumn("groups", level)
    flat = texts.select("document_id", F.posexplode(outer).alias("chunk_index", "c"))
    cut = lambda c: F.left(trimmed(F.col(f"c.{c}")), F.lit(MOST_HEADING))
    return flat.select(
        "document_id", "chunk_index", cut("heading").alias("heading"), cut("path").alias("section_path"),
        F.col("c.text").alias("content"), F.char_length("c.text").alias("character_count"),
    )
