"""Byte-level BPE encoding and decoding with built-in Spark functions.

1. A pattern cuts texts into words, and one aggregation counts the distinct ones.
2. ``encode_word`` folds ranked merges over a word's bytes: the state is an array
   of token ids, one for each byte at first. Each step takes the lowest rank of all
   adjacent pairs and merges that pair, until no pair is in the map. The rank of a pair
   is the id of its concatenation, so what is left is the encoding.
3. Distinct words are dealt to ``memo_slots`` slots by their hash. The ``WAYS`` most frequent
   words of each slot are encoded once, and the slots form one row of arrays, which is a
   table of a proven size (words have at most ``MEMO_CHARS`` code points). Texts look
   their words up there and fold the others where they stand, so texts are never
   shuffled and no word is left out.
4. Decoding looks up the bytes of each id and concatenates them.

The literal maps are perfect hash tables in arrays, since Spark searches its own maps
from end to end. A slot names its key, so a look-up that meets another one's is known.
The fold's state holds the entries of the adjacent pairs too, and a merge looks up the
two new ones only. In words of up to ``SHORT`` bytes a place is one number, of the entry of
its pair, where it began and its token, so that the least number is the leftmost place of
the lowest pair.

Words of more than ``SHORT`` bytes are cut first wherever no token of the vocabulary
reaches across, which the four bytes around a place tell: no merge can either. Parts that
are still longer merge all places of the lowest pair at once, runs of one token pairwise
from the left, in rounds that end when nothing is left to merge. This equals merging one
after another from the left unless the new token could merge on at once with a lower
rank; that is known for each token, and then only the leftmost place is merged.

Defined cases: null and empty texts have no ids; words of any length are encoded
whole; ids outside the vocabulary and null ids decode to nothing; rows with null or
repeated ids are encoded each by itself. Extra columns are not touched. A vocabulary
with a rank that the tables cannot hold is refused.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heronmill.llm.shared import new_name, stored

#: White space as the tiktoken library's pattern engine has it; Java's ``\\s`` is narrower.
WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
MEMO_CHARS = 24
SHORT = 48
#: Separates the byte strings of literals; no byte is this character.
GAP = "\u0100"
#: A pair's key is ``left << ID_BITS | right``, its slot ``key << RANK_BITS | rank << 1 | unsafe``.
ID_BITS = 17
RANK_BITS = 18
#: A key's slot is at ``(key % mix + shift[key % buckets]) % slots``, with the first of these that fits.
MIXES = (1_000_003, 998_244_353, 2_147_483_647, 1_000_000_007)
#: Stands before the first and after the last byte, and is in no pair.
EDGE = (1 << ID_BITS) - 1
FREE = 1 << 60
#: Words that a slot of the table of frequent words holds, a power of two.
WAYS = 4
#: A place of a short word is ``entry << PLACE_BITS | byte << ID_BITS | token``; the entry is ``NO_PAIR`` if there is none.
PLACE_BITS = ID_BITS + 6
NO_PAIR = 1 << RANK_BITS
#: The two edges of a word as the code of a byte.
EDGE_CODE = ord(GAP)


def java_pattern(pattern: str) -> str:
    """``pattern`` with its white space classes spelled out."""
    return pattern.replace(r"[^\s", "[^" + WHITE).replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def displaced(entries: dict[int, int], mix: int) -> tuple[np.ndarray, np.ndarray] | None:
    """Shifts of buckets of keys under which no two keys share a slot, and the slots, if there are such."""
    rng = np.random.default_rng(3)
    n_buckets, size = len(entries) // 3 | 1, len(entries) * 3 // 2 | 1
    buckets: dict[int, list[int]] = {}
    for key in entries:
        buckets.setdefault(key % n_buckets, []).append(key)
    slots, shifts = np.full(size, FREE), [0] * n_buckets
    for bucket, keys in sorted(buckets.items(), key=lambda x: (-len(x[1]), x[0])):
        mixed = np.array(keys) % mix
        if len(set((mixed % size).tolist())) < len(keys):
            return None
        for _ in range(10_000):
            tries = rng.integers(0, size, 16)
            places = (tries[:, None] + mixed) % size
            fits = np.flatnonzero((slots[places] == FREE).all(axis=1))
            if len(fits):
                shifts[bucket] = int(tries[fits[0]])
                slots[places[fits[0]]] = [entries[k] for k in keys]
                break
        else:
            return None
    return np.array(shifts), slots


@dataclass(frozen=True)
class Table:
    """A perfect hash table: arrays of numbers, or columns of them."""

    mix: int
    n_shifts: int
    n_slots: int
    shifts: np.ndarray | Column
    slots: np.ndarray | Column

    @staticmethod
    def of(entries: dict[int, int]) -> Table:
        for mix in MIXES:
            found = displaced(entries, mix)
            if found:
                shifts, slots = found
                return Table(mix, len(shifts), len(slots), shifts, slots)
        raise ValueError("the keys of this vocabulary do not fit")

    def slot(self, key: Column) -> Column:
        """What stands where ``key`` would; null for a null key."""
        return F.get(self.slots, (key % self.mix + F.get(self.shifts, key % self.n_shifts)) % self.n_slots)


def span_key(kind: int, *window: int) -> int:
    """The key of bytes around a place that a token reaches across."""
    key = kind
    for b in window:
        key = key << 8 | b
    return key


def spans_of(tokens: list[bytes]) -> dict[int, int]:
    """Keys of all places inside tokens, by whether a token ends one byte before or after them."""
    keys = set()
    for t in tokens:
        for k in range(1, len(t)):
            left, right = t[max(0, k - 2) : k], t[k : k + 2]
            keys.add(span_key(4 + 2 * (len(left) > 1) + (len(right) > 1), *left, *right))
    return {k: k for k in keys}


@dataclass(frozen=True)
class Vocabulary:
    """What encoding and decoding look up."""

    pairs: Table
    spans: Table
    byte_ids: list[int]
    starts: np.ndarray
    pieces: Column
    little_endian: Column
    pattern: str

    @staticmethod
    @cache
    def load(path: str, pattern: str) -> Vocabulary:
        ranks = read_ranks(path)
        if max(ranks.values()) >= EDGE or min(ranks.values()) < 0:
            raise ValueError(f"ranks must be from 0 to {EDGE - 1}")
        pairs: dict[tuple[int, int], int] = {}
        onward: dict[int, int] = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left, right] = rank
                    for part in (left, right):
                        onward[part] = min(onward.get(part, rank), rank)
        entries = {}
        for (left, right), rank in pairs.items():
            key = left << ID_BITS | right
            entries[key] = key << RANK_BITS | rank << 1 | (onward.get(rank, rank) < rank)
        byte_ids = [ranks[bytes([b])] for b in range(256)]
        starts = np.full((EDGE_CODE + 1, EDGE_CODE + 1), NO_PAIR << PLACE_BITS)
        for left, one in enumerate(byte_ids):
            for right, other in enumerate(byte_ids):
                key = one << ID_BITS | other
                if key in entries:
                    starts[left, right] = (entries[key] ^ key << RANK_BITS) << PLACE_BITS
        starts |= np.array([*byte_ids, EDGE])[:, None]
        pieces = [""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            pieces[rank] = token.decode("latin-1")
        return Vocabulary(
            Table.of(entries),
            Table.of(spans_of(list(ranks))),
            byte_ids,
            starts.ravel(),
            F.split(F.lit(GAP.join(pieces)), GAP),
            F.split(F.lit(GAP.join(r.to_bytes(4, "little").decode("latin-1") for r in range(len(pieces)))), GAP),
            java_pattern(pattern),
        )


_ROWS: dict[tuple[str, int], DataFrame] = {}


def constants(spark: SparkSession, vocab: Vocabulary) -> DataFrame:
    """The rank map and the other tables of numbers as one row, whose arrays are flat memory in plans and tasks."""
    key = spark.sparkContext.applicationId, id(vocab)
    if key not in _ROWS:
        arrays = (vocab.pairs.shifts, vocab.pairs.slots, vocab.spans.shifts, vocab.spans.slots, vocab.byte_ids, vocab.starts)
        row = pa.table({name: pa.array([a], pa.list_(pa.int64())) for name, a in zip(CONSTANTS, arrays)})
        _ROWS[key] = stored(spark.createDataFrame(row), "bpe-constants")
    return _ROWS[key]


CONSTANTS = ("pair_shifts", "pair_slots", "span_shifts", "span_slots", "byte_ids", "starts")


def with_one_row(df: DataFrame, *tables: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with each table of one row as a subquery of one struct, and the names of these columns.

    Spark puts each where it is used, if that is one place: then it never becomes part of a row. Subqueries
    for single columns would be merged, and tasks would then get the whole row once for each of its columns.
    """
    names, columns = [], {}
    for table in tables:
        names.append(new_name(df, f"one_{len(names)}"))
        columns[names[-1]] = table.select(F.struct(*table.columns)).scalar()
    return df.withColumns(columns), names


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once.

    An aggregate over nothing binds its start and finishes. An array of one transformed would do too, but
    taking its element works out the type of the whole body for every value, and the result is copied.
    """
    return F.aggregate(F.array(), value, lambda bound, _: bound, body)


def lets(row: Column, names: list[str] | tuple[str, ...], body: Callable[..., Column]) -> Column:
    """``body`` of the fields ``names`` of ``row``, each computed once."""

    def rest(bound: Column, *got: Column) -> Column:
        if len(got) == len(names):
            return body(*got)
        return let(bound[names[len(got)]], lambda x: rest(bound, *got, x))

    return let(row, lambda bound: rest(bound))


@dataclass(frozen=True)
class Bound:
    """The tables inside an expression."""

    pairs: Table
    spans: Table
    byte_ids: Column
    starts: Column

    @staticmethod
    def within(vocab: Vocabulary, row: Column, body: Callable[[Bound], Column]) -> Column:
        """``body`` of the constants in ``row``."""
        return lets(
            row,
            CONSTANTS,
            lambda a, b, c, d, e, f: body(
                Bound(replace(vocab.pairs, shifts=a, slots=b), replace(vocab.spans, shifts=c, slots=d), e, f)
            ),
        )

    def entry(self, left: Column, right: Column) -> Column:
        """``rank << 1 | unsafe`` of a pair; more than any rank, or null, if it is none."""
        return let(
            F.shiftleft(left, ID_BITS) + right,
            lambda key: self.pairs.slot(key).bitwiseXOR(F.shiftleft(key, RANK_BITS)),
        )

    def entries(self, ids: Column) -> Column:
        lefts = F.slice(ids, F.lit(1), F.size(ids) - 1)
        return F.transform(lefts, lambda x, i: self.entry(x, F.get(ids, i + 1)))

    def reached(self, codes: Column, at: Column) -> Column:
        """Whether some token reaches across the place before byte ``at``, from 1."""
        before, left, right, after = (F.get(codes, at + k) for k in (-2, -1, 0, 1))
        keys = (
            (4 << 16) + left * 256 + right,
            (5 << 24) + left * 65536 + right * 256 + after,
            (6 << 24) + before * 65536 + left * 256 + right,
            (7 << 32) + before * (1 << 24) + left * 65536 + right * 256 + after,
        )
        return F.exists(F.array(*(k.cast("bigint") for k in keys)), lambda k: self.spans.slot(k).eqNullSafe(k) & k.isNotNull())


def state_of(ids: Column, entries: Column) -> Column:
    return F.struct(ids.alias("ids"), entries.alias("entries"))


def place_of(entry: Column, rest: Column) -> Column:
    """A place of a short word; ``rest`` is where it began and its token."""
    return let(
        entry,
        lambda e: F.when(e < NO_PAIR, F.shiftleft(e, PLACE_BITS) + rest).otherwise(rest + (NO_PAIR << PLACE_BITS)),
    )


def token_of(place: Column) -> Column:
    return place.bitwiseAND(F.lit(EDGE).cast("bigint"))


def merge_least(places: Column, least: Column, bound: Bound) -> Column:
    """The leftmost pair of the lowest entry becomes one token; the edges are in no pair, so it has neighbours."""

    def put(before: Column, gone: Column, new_before: Column, new: Column) -> Column:
        # No two places are equal. Spark's slices and concatenations of arrays take several times as long as this.
        more = F.transform(places, lambda x: F.when(x == before, new_before).when(x == least, new).otherwise(x))
        return F.array_remove(more, gone)

    def at_place(at: Column, token: Column, before: Column) -> Column:
        rest = F.lit((1 << PLACE_BITS) - 1).cast("bigint")
        began = F.lit((1 << PLACE_BITS) - 1 - EDGE).cast("bigint")
        new_before = place_of(bound.entry(token_of(before), token), before.bitwiseAND(rest))
        new = place_of(bound.entry(token, token_of(F.get(places, at + 1))), least.bitwiseAND(began) + token)
        return let(F.get(places, at), lambda x: let(new_before, lambda y: let(new, lambda z: put(before, x, y, z))))

    return let(
        F.array_position(places, least),
        lambda at: let(
            F.shiftright(least, PLACE_BITS + 1),
            lambda token: let(F.get(places, at - 2), lambda before: at_place(at, token, before)),
        ),
    )


def fold_short(part: Column, bound: Bound) -> Column:
    """Token ids of at most ``SHORT`` bytes given as characters."""
    def start(codes: Column) -> Column:
        return F.transform(
            codes,
            lambda c, i: F.get(bound.starts, c * (EDGE_CODE + 1) + F.coalesce(F.get(codes, i + 1), F.lit(EDGE_CODE)))
            + F.shiftleft(i, ID_BITS),
        )

    def step(places: Column, _: Column) -> Column:
        return let(
            F.array_min(places),
            lambda least: F.when(least >= NO_PAIR << PLACE_BITS, places).otherwise(merge_least(places, least, bound)),
        )

    def merged(letters: Column) -> Column:
        # One step for each merge there can be, and three more.
        states = let(F.transform(letters, F.ascii), lambda codes: F.aggregate(letters, start(codes), step))
        return F.array_remove(F.transform(states, token_of), EDGE)

    # The edges' code is that of GAP.
    return let(F.split(F.concat(F.lit(GAP), part, F.lit(GAP)), ""), merged)


def merge_all(ids: Column, entries: Column, least: Column, bound: Bound) -> Column:
    """Every place of the lowest entry merges, or the leftmost if the token is unsafe."""
    flags = F.array_join(F.transform(entries, lambda e: F.when(e.eqNullSafe(least), "1").otherwise("0")), "")
    chosen = F.when(least % 2 == 1, F.regexp_replace(flags, "^(0*1).*$", "$1")).otherwise(
        F.regexp_replace(flags, "11", "10")
    )
    merged = let(
        F.split(chosen, ""),
        lambda on: F.filter(
            F.transform(
                ids,
                lambda x, i: F.when(F.get(on, i) == "1", F.shiftright(least, 1))
                .when(F.get(on, i - 1) == "1", F.lit(None).cast("bigint"))
                .otherwise(x),
            ),
            lambda x: x.isNotNull(),
        ),
    )
    return let(merged, lambda out: state_of(out, bound.entries(out)))


def latin(text: Column) -> Column:
    """The bytes of ``text`` as characters."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, text).otherwise(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"))


def parts_of(word: Column, bound: Bound) -> Column:
    """The bytes of a long word as characters, cut where no token can reach across."""

    def cut(letters: Column) -> Column:
        return let(
            F.transform(letters, lambda c: F.ascii(c).cast("bigint")),
            lambda codes: F.array_join(
                F.transform(
                    letters,
                    lambda c, i: F.when((i > 0) & ~bound.reached(codes, i), F.concat(F.lit(GAP), c)).otherwise(c),
                ),
                "",
            ),
        )

    return F.split(let(F.split(latin(word), ""), cut), GAP)


def fold_long(part: Column, bound: Bound) -> Column:
    """Token ids of any number of bytes given as characters."""
    edge = F.array(F.lit(EDGE).cast("bigint"))
    start = F.concat(edge, F.transform(F.split(part, ""), lambda c: F.get(bound.byte_ids, F.ascii(c))), edge)

    def least_of(state: Column) -> Column:
        return F.coalesce(F.array_min(state["entries"]), F.lit(FREE))

    def step(state: Column) -> Column:
        return let(
            least_of(state),
            lambda least: F.when(least >= NO_PAIR, state).otherwise(
                merge_all(state["ids"], state["entries"], least, bound)
            ),
        )

    def merged(ids: Column) -> Column:
        turns = F.sequence(F.lit(1), F.ceil(F.sqrt(F.size(ids))).cast("int"))
        return F.aggregate(
            turns,
            state_of(ids, bound.entries(ids)),
            lambda s, _: F.when(least_of(s) >= NO_PAIR, s).otherwise(F.aggregate(turns, s, lambda t, _: step(t))),
            lambda s: s["ids"],
        )

    return let(let(start, merged), lambda ids: F.slice(ids, F.lit(2), F.size(ids) - 2))


def fold(part: Column, bound: Bound) -> Column:
    """Token ids of bytes given as characters."""
    return F.when(F.char_length(part) <= SHORT, fold_short(part, bound)).otherwise(fold_long(part, bound))


def encode_word(word: Column, bound: Bound) -> Column:
    """Token ids of one word."""
    long = F.flatten(F.transform(parts_of(word, bound), lambda part: fold(part, bound)))
    return F.when(F.octet_length(word) <= SHORT, fold_short(latin(word), bound)).otherwise(long).cast("array<int>")


def words_of(text: Column, vocab: Vocabulary) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(vocab.pattern), F.lit(0))


def slot_of(word: Column, slots: int) -> Column:
    """The first place of a word's slot; slots are a power of two, as are their places."""
    return F.xxhash64(word).bitwiseAND(F.lit((slots - 1) * WAYS).cast("bigint")).cast("int")


def memo(docs: DataFrame, text_col: str, vocab: Vocabulary, memo_slots: int) -> tuple[int, DataFrame]:
    """The number of slots, a power of two, and one row with the words and ids of ``WAYS`` places for each."""
    counts = docs.select(F.explode(words_of(F.col(text_col), vocab)).alias("word")).groupBy("word").count()

    def leaders(rows: DataFrame, slots: int) -> DataFrame:
        first = Window.partitionBy("slot").orderBy(F.desc("count"), F.desc("word"))
        ranked = rows.withColumn("slot", slot_of(F.col("word"), slots)).withColumn("way", F.row_number().over(first) - 1)
        return ranked.where(F.col("way") < WAYS).select("slot", "way", "word", "count")

    # ``WAYS`` words a slot at most, so this is bounded however many words there are.
    best = stored(leaders(counts.where(F.char_length("word") <= MEMO_CHARS), memo_slots), "frequent-words")
    slots = min(memo_slots, 1 << (2 * best.count() // WAYS).bit_length())
    dealt, (constant,) = with_one_row(
        leaders(best, slots).repartition(max(1, slots * WAYS >> 14), "slot"), constants(docs.sparkSession, vocab)
    )
    ids = Bound.within(vocab, F.col(constant), lambda bound: encode_word(F.col("word"), bound)).alias("ids")
    place = (F.col("slot") + F.col("way")).alias("place")
    encoded = stored(dealt.select(place, "word", ids), "encoded-words")
    every = docs.sparkSession.range(slots * WAYS).select(F.col("id").cast("int").alias("place"))
    every = every.join(encoded, "place", "left")
    rows = every.agg(F.sort_array(F.collect_list(F.struct("place", "word", "ids"))).alias("rows"))  # one row of all slots
    table = rows.select(
        F.transform("rows", lambda r: r["word"]).alias("words"), F.transform("rows", lambda r: r["ids"]).alias("ids")
    )
    return slots, stored(table, "word-table")


def encode(
    docs: DataFrame, vocab: Vocabulary, text_col: str = "text", out: str = "ids", memo_slots: int = 1 << 17
) -> DataFrame:
    """``docs`` with the token ids of each whole text in column ``out``."""
    slots, table = memo(docs, text_col, vocab, memo_slots)

    def ids_of(word: Column, words: Column, known: Column, bound: Bound) -> Column:
        return let(
            slot_of(word, slots),
            lambda at: reduce(
                lambda rest, way: F.when(F.get(words, at + way) == word, F.get(known, at + way)).otherwise(rest),
                reversed(range(WAYS)),
                encode_word(word, bound),
            ),
        )

    own = words_of(F.col(text_col), vocab)
    rows, names = with_one_row(docs, table, constants(docs.sparkSession, vocab))

    def with_memo(words: Column, known: Column) -> Column:
        return Bound.within(vocab, F.col(names[1]), lambda b: F.transform(own, lambda w: ids_of(w, words, known, b)))

    return rows.withColumn(out, F.flatten(lets(F.col(names[0]), table.columns, with_memo))).drop(*names)


def looked_up(ids: Column, table: Column) -> Column:
    """The byte strings of ``table`` for ``ids``, concatenated."""
    return F.encode(F.array_join(let(table, lambda t: F.transform(ids, lambda i: F.get(t, i))), ""), "ISO-8859-1")


def decode(ids: Column, vocab: Vocabulary) -> Column:
    """The bytes that ``ids`` stand for."""
    return looked_up(ids, vocab.pieces)


def id_bytes(ids: Column, vocab: Vocabulary) -> Column:
    """``ids`` as little-endian unsigned 32-bit integers."""
    return looked_up(ids, vocab.little_endian)


def digest(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Rows of query op1."""
    return encode(docs.select("doc_id", "text"), vocab).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(id_bytes(F.col("ids"), vocab), 256).alias("ids_sha256"),
        F.sha2(decode(F.col("ids"), vocab), 256).alias("decoded_sha256"),
    )
