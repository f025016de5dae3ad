"""Units and chunks of source code as a plan over lines.

A lexical automaton reads every line by itself, for both states in which it can be entered (outside and inside a
block comment), and gives the state after it and the braces it opens. The entry state of each line is the composition
of the functions before it: a running window, since of two states a function keeps, swaps or sets. Strings end with
their line. Brace depth never falls below zero, so it is the running sum less its running minimum.

Units of languages with braces end at empty lines at depth zero; those of indented languages begin at the margin, with
the comments before them (J20, J36). Units that are too long are cut at their lines of least indentation (J22),
then by size (H15). Pieces are packed in order, without overlaps (J33), and a chunk has the symbol that all its units
share (J23). Lines of JSON lines are pieces by themselves (J19). Of other JSON the tokens are rows: depths are running sums,
the members around a token are the last ones of each lower depth, and the highest members that fit are the
pieces, with their paths as symbols (J18, J30 to J32). JSON that cannot be read is cut as code with braces.

Defined cases: null and blank sources give nothing; rows that repeat an id each give their own units; an unknown or
null language has braces and no comments with ``#``.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heronmill.functions import classify as K
from heronmill.functions import text as X
from heronmill.functions.folds import emitted, let, trimmed
from heronmill.functions.json_values import is_container
from heronmill.operators.chunks import GAP, MOST_HEADING, Limits, chunk_documents, none_of
from heronmill.sources.storage import stored

INDENTED = ("python", "yaml")
HASH_COMMENTS = ("shell", "powershell", "batch", "ruby", "perl", "r", "yaml", "python")
#: What stands in strings and comments that end on their line; all quantifiers give nothing back.
STRINGS = "|".join(rf"{q}[^{q}\\]*+(?:\\.[^{q}\\]*+)*+(?:{q}|\\?$)" for q in "\"'`")
TOKENS = rf"(?s){STRINGS}|//.*$|/\*.*?\*/"
#: Kinds of symbols and the words that declare them, the first kind that a unit has counts.
DECLARES = (("class", "class|interface|enum"), ("function", "function|def|fn|func"), ("struct", "struct"), ("variable", "const|let|var"))
BEFORE = r"(?m)^[ \t]*(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|export|default|async|pub)[ \t]+)*+"


def scanned(code: Column, hashes: Column) -> Column:
    """What a line does that begins outside of comments: whether it ends inside one, and its braces less those it closes."""
    tokens = F.when(hashes, F.regexp_replace(code, TOKENS.replace("|//", "|#.*$|//"), " ")).otherwise(F.regexp_replace(code, TOKENS, " "))

    def counted(bare: Column) -> Column:
        opened = F.instr(bare, "/*")
        own = F.when(opened > 0, F.left(bare, opened - 1)).otherwise(bare)
        braces = let(own, lambda s: F.char_length(F.translate(s, "}", "")) - F.char_length(F.translate(s, "{", "")))
        return F.struct((opened > 0).alias("inside"), braces.alias("braces"))

    # Most lines have none of the signs that matter.
    plain = F.struct(F.lit(False).alias("inside"), F.lit(0).alias("braces"))
    return F.when(code.rlike(r"[{}]|/\*"), let(tokens, counted)).otherwise(plain)


def read_lines(sources: DataFrame, id_col: str, text_col: str, language_col: str) -> DataFrame:
    """(row, document_id, language, at, line, depth): lines with the brace depth before each."""
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = sources.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("document_id"),
        F.coalesce(F.col(language_col), F.lit("")).alias("language"), F.col(text_col).alias("text"),
    ).where("text IS NOT NULL")
    lines = keyed.repartition(parts, "row").select(
        "row", "document_id", "language", F.posexplode(F.split(X.newlines(F.col("text")), "\n")).alias("at", "line")
    )
    line, hashes = F.col("line"), F.col("language").isin(*HASH_COMMENTS)
    ends = F.instr("line", "*/")
    rest = F.substr(line, ends + 2)
    inside = F.when(ends > 0, scanned(rest, hashes)).otherwise(F.struct(F.lit(True).alias("inside"), F.lit(0).alias("braces")))
    read = lines.withColumns({"out": scanned(line, hashes), "in": inside})
    order = Window.partitionBy("row").orderBy("at")
    upto, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    # A line sets the state, or swaps it, or keeps it.
    sets = F.col("out.inside") == F.col("in.inside")
    swaps = F.col("out.inside") & ~F.col("in.inside")
    read = read.withColumn("swapped", F.count_if(swaps).over(upto))
    was = F.last(F.when(sets, F.struct(F.col("out.inside").alias("inside"), "swapped")), ignorenulls=True).over(earlier)
    read = read.withColumns({"was": was, "before": F.coalesce(F.lag("swapped").over(order), F.lit(0))})
    flips = (F.col("before") - F.coalesce("was.swapped", F.lit(0))) % 2 == 1
    entered = F.coalesce("was.inside", F.lit(False)) != flips
    read = read.withColumn("braces", F.when(entered, F.col("in.braces")).otherwise(F.col("out.braces")))
    read = read.withColumn("sum", F.sum("braces").over(upto))
    low = F.least(F.min("sum").over(earlier), F.lit(0))
    depth = F.coalesce(F.lag("sum").over(order) - low, F.lit(0)).cast("int")
    return read.withColumn("depth", depth).select("row", "document_id", "language", "at", "line", "depth")


def symbol_of(text: Column, language: Column) -> Column:
    """Name and kind of what a unit declares, or blanks."""

    def found(kind: str, pattern: str, name: Column | None = None) -> Column:
        own = F.regexp_extract(text, pattern, 1) if name is None else name
        return F.when(own != "", F.struct(own.alias("symbol"), F.lit(kind).alias("symbol_type")))

    method = r"(?m)^func \((?:\w+ )?\*?(\w+)(?:\[[^\]]*\])?\) (\w+)"
    receiver = F.regexp_extract(text, method, 1)
    method_name = F.when(receiver != "", F.concat(receiver, F.lit("."), F.regexp_extract(text, method, 2))).otherwise("")
    go = F.coalesce(
        found("method", method, method_name),
        found("function", r"(?m)^func (\w+)"),
        found("struct", r"(?m)^type (\w+)(?:\[[^\]]*\])? struct\b"),
        found("interface", r"(?m)^type (\w+)(?:\[[^\]]*\])? interface\b"),
        found("type", r"(?m)^type (\w+)"),
        found("constant", r"(?m)^const (\w+)"),
        found("variable", r"(?m)^var (\w+)"),
    )
    tails = {"variable": r"[ \t]+(\w+)[ \t]*=", "function": r"[ \t]+(?:\([^)]*\)[ \t]*)?(\w+)"}
    other = F.coalesce(*(found(k, rf"{BEFORE}(?:{words}){tails.get(k, r'[ \t]+(\w+)')}") for k, words in DECLARES))
    none = F.struct(F.lit("").alias("symbol"), F.lit("").alias("symbol_type"))
    return F.coalesce(F.when(language == "go", go).otherwise(other), none)


def blank(line: Column) -> Column:
    return trimmed(line) == ""


def units_of(sources: DataFrame, id_col: str, text_col: str, language_col: str) -> DataFrame:
    """(row, document_id, language, unit, lines): the units of every source in order, each with its lines."""
    order = Window.partitionBy("row").orderBy("at")
    upto, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    line = F.col("line")
    rows = read_lines(sources, id_col, text_col, language_col).withColumns(
        {"empty": blank(line), "margin": ~line.rlike("^[ \t]"), "note": trimmed(line).rlike(r"^(?:#|//|/?\*)")}
    )
    solid = F.last(F.when(~F.col("empty") & ~F.col("note"), F.col("at")), ignorenulls=True).over(earlier)
    top = F.last(F.when(~F.col("empty") & F.col("margin"), F.col("at")), ignorenulls=True).over(earlier)
    indented = F.col("language").isin(*INDENTED)
    by_line = F.col("language") == "jsonl"
    # Comments at the margin go with what they stand before.
    begins = ~F.col("empty") & F.col("margin") & (solid >= F.coalesce(top, F.lit(-1)))
    gap = F.col("empty") & (F.col("depth") == 0)
    new = F.when(by_line, F.lit(True)).when(indented, F.coalesce(begins, F.lit(False))).otherwise(gap)
    rows = rows.withColumn("new", new).withColumn("unit", F.count_if("new").over(upto))
    kept = F.when(indented | by_line | ~gap, F.struct("at", "line"))
    grouped = rows.groupBy("row", "document_id", "language", "unit").agg(F.array_sort(F.collect_list(kept)).alias("lines"))
    texts = grouped.withColumn("text", trimmed(F.array_join(F.transform("lines", lambda r: r["line"]), "\n")))
    return texts.where("text <> ''").drop("lines")


def indent(line: Column) -> Column:
    return F.char_length(F.replace(F.regexp_extract(line, "^[ \t]*", 0), F.lit("\t"), F.lit("    ")))


def hard_split(text: Column, most: int) -> Column:
    """Lines joined while they fit; longer lines are cut."""

    def step(held: Column, line: Column) -> tuple[Column, Column]:
        def put(n: Column) -> Column:
            over = (held != "") & (F.char_length(held) + 1 + n > most)
            cuts = F.greatest(F.ceil(n / most).cast("int") - 1, F.lit(0))
            full = F.when(cuts > 0, F.transform(F.sequence(F.lit(0), cuts - 1), lambda k: F.substr(line, k * most + 1, F.lit(most))))
            rest = F.substr(line, cuts * most + 1)
            kept = F.when(over, F.lit("")).otherwise(held)
            after = F.when(n == 0, kept).when(kept == "", rest).otherwise(F.concat(kept, F.lit("\n"), rest))
            out = F.concat(F.when(over, F.array(held)).otherwise(none_of("string")), F.coalesce(full, none_of("string")))
            return F.struct(after.alias("after"), out.alias("out"))

        both = let(F.char_length(line), put)
        return both["after"], both["out"]

    cut = emitted(F.split(text, "\n"), "string", F.lit(""), "string", step, lambda held: F.array(held))
    return F.when(F.char_length(text) <= most, F.array(text)).otherwise(F.filter(cut, lambda t: trimmed(t) != ""))


def unit_pieces(text: Column, most: int) -> Column:
    """A unit as texts that fit: whole, or cut at its lines of least indentation, or by size."""

    def cut(lines: Column) -> Column:
        tail = F.filter(F.slice(lines, F.lit(2), F.size(lines)), lambda s: ~blank(s))
        base = F.array_min(F.transform(tail, indent))

        def parted(least: Column) -> Column:
            def step(held: Column, s: Column) -> tuple[Column, Column]:
                starts = held.isNotNull() & ~blank(s) & (indent(s) == least)
                after = F.when(starts | held.isNull(), s).otherwise(F.concat(held, F.lit("\n"), s))
                return after, F.when(starts, F.array(held)).otherwise(none_of("string"))

            return emitted(lines, "string", F.lit(None), "string", step, lambda held: F.array(held))

        def sized(parts: Column) -> Column:
            texts = F.filter(F.transform(parts, trimmed), lambda t: t != "")
            return F.when(F.size(parts) < 2, hard_split(text, most)).otherwise(F.flatten(F.transform(texts, lambda t: hard_split(t, most))))

        return F.when(base.isNull(), hard_split(text, most)).otherwise(let(let(base, parted), sized))

    return F.when(F.char_length(text) <= most, F.array(text)).otherwise(let(F.split(text, "\n"), cut))


PIECE = "struct<text: string, symbol: string, symbol_type: string>"
PART = "struct<body: string, symbol: string, symbol_type: string, mixed: boolean>"


@cache
def packed_code(limits: Limits) -> Column:
    """The chunks of the pieces in the column ``pieces``, joined by ``gap``: filled in order, without a short end."""
    gap = F.col("gap")

    def grown(held: Column, p: Column) -> Column:
        other = (p["symbol"] != "") & (held["symbol"] != "") & (p["symbol"] != held["symbol"])
        first = held["symbol"] == ""
        return F.struct(
            F.concat(held["body"], gap, p["text"]), F.when(first, p["symbol"]).otherwise(held["symbol"]),
            F.when(first, p["symbol_type"]).otherwise(held["symbol_type"]), held["mixed"] | other,
        ).cast(PART)

    def step(held: Column, p: Column) -> tuple[Column, Column]:
        over = held.isNotNull() & (F.char_length(held["body"]) + F.char_length(gap) + F.char_length(p["text"]) > limits.fill)
        fresh = F.struct(p["text"], p["symbol"], p["symbol_type"], F.lit(False)).cast(PART)
        return F.when(over | held.isNull(), fresh).otherwise(grown(held, p)), F.when(over, F.array(held)).otherwise(none_of(PART))

    def ended(parts: Column) -> Column:
        last, other = F.get(parts, F.size(parts) - 1), F.get(parts, F.size(parts) - 2)
        whole = F.struct(last["body"].alias("text"), last["symbol"].alias("symbol"), last["symbol_type"].alias("symbol_type"))
        both = let(whole, lambda p: F.struct(grown(other, p).alias("p"), last["mixed"].alias("m")))
        joined = let(both, lambda b: F.struct(b["p"]["body"], b["p"]["symbol"], b["p"]["symbol_type"], b["p"]["mixed"] | b["m"]).cast(PART))
        short = (F.size(parts) >= 2) & (F.char_length(trimmed(last["body"])) < limits.least)

        def put(one: Column) -> Column:
            fits = F.char_length(trimmed(one["body"])) <= limits.most + limits.overlap
            return F.when(fits, F.concat(F.slice(parts, F.lit(1), F.size(parts) - 2), F.array(one))).otherwise(parts)

        return F.when(short, let(joined, put)).otherwise(parts)

    return let(emitted(F.col("pieces"), PART, F.lit(None), PART, step, lambda held: F.array(held)), ended)


#: Tokens with the white space behind them.
JSON_TOKENS = r'(?:"[^"\\]*+(?:\\.[^"\\]*+)*+"|[{}\[\],:]|[^\s{}\[\],:"]++)\s*+'
#: Members below this depth are not opened.
MOST_DEPTH = 9


def json_pieces(sources: DataFrame, id_col: str, text_col: str, limits: Limits) -> DataFrame:
    """(row, document_id, unit, pieces): the highest members and elements of each text that fit, in order.

    ``under`` is the number of brackets around a token. A member begins behind a bracket or a comma and ends
    before the next comma or closing bracket of its depth, which is sought in the order from the end.
    """
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = sources.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("document_id"), trimmed(X.newlines(F.col(text_col))).alias("text")
    ).repartition(parts, "row")
    tokens = rows.select("row", "document_id", F.posexplode(F.regexp_extract_all("text", F.lit(JSON_TOKENS), F.lit(0))).alias("k", "full"))
    order = Window.partitionBy("row").orderBy("k")
    upto, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    back = Window.partitionBy("row").orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, -1)
    token, depths = F.col("token"), range(1, MOST_DEPTH + 1)
    opens, closes = token.isin("{", "["), token.isin("}", "]")
    read = tokens.withColumn("token", F.regexp_replace("full", "\\s+$", "")).withColumns(
        {
            "at": F.coalesce(F.sum(F.char_length("full")).over(earlier), F.lit(0)),
            "under": F.coalesce(F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(earlier), F.lit(0)),
        }
    )
    behind = F.lead(F.struct("at", "token"), 2).over(order)
    read = read.withColumns(
        {
            "was": F.lag("token").over(order),
            "was_end": F.lag(F.col("at") + F.char_length("token")).over(order),
            "object": F.coalesce(F.lead("token").over(order) == ":", F.lit(False)),
            "behind": behind,
        }
    )
    separates = closes | (token == ",")
    read = read.withColumns(
        {
            "starts": ~closes & ~token.isin(",", ":") & F.coalesce(F.col("was").isin("{", "[", ","), F.lit(False)) & (F.col("under") <= MOST_DEPTH),
            "begin": F.when(F.col("object"), F.col("behind.at")).otherwise(F.col("at")),
            "value": F.when(F.col("object"), F.col("behind.token")).otherwise(token),
        }
        | {f"e{d}": F.last(F.when((F.col("under") == d) & separates, F.col("was_end")), ignorenulls=True).over(back) for d in depths}
    )
    end = F.coalesce(*(F.when(F.col("under") == d, F.col(f"e{d}")) for d in depths))
    held = {d: F.last(F.when(F.col("starts") & (F.col("under") == d), F.col("k")), ignorenulls=True).over(earlier) for d in depths}
    read = read.withColumns(
        {"end": end, "parent": F.coalesce(*(F.when(F.col("under") == d, held[d - 1]) for d in depths[1:]), F.lit(-1))}
    ).drop(*(f"e{d}" for d in depths))
    size = F.col("end") - F.col("begin") + F.when(F.col("object"), F.char_length("token") + 2).otherwise(0)
    place = F.row_number().over(Window.partitionBy("row", "parent", "under", "starts").orderBy("k")) - 1
    named = F.when(F.col("object"), F.substr("token", F.lit(2), F.char_length("token") - 2)).otherwise(
        F.concat(F.lit("["), place.cast("string"), F.lit("]"))
    )
    read = read.withColumns({"fits": size <= limits.fill, "name": named})
    own = F.struct("name", "object", "fits")
    above = [
        F.when(F.col("under") > d, F.last(F.when(F.col("starts") & (F.col("under") == d), own), ignorenulls=True).over(earlier))
        for d in depths[:-1]
    ]
    read = read.withColumn("above", F.array_compact(F.array(*above)))
    path = F.aggregate(
        F.concat("above", F.array(own)), F.lit(""),
        lambda p, m: F.when((p == "") | ~m["object"], F.concat(p, m["name"])).otherwise(F.concat(p, F.lit("."), m["name"])),
    )
    leaf = ~F.col("value").isin("{", "[") | (F.col("under") == MOST_DEPTH)
    chosen = F.col("starts") & (F.col("fits") | leaf) & ~F.exists("above", lambda m: m["fits"])
    head = F.when(F.col("object") & F.col("fits"), F.concat("token", F.lit(": "))).otherwise("")
    mine = F.struct(F.col("k").alias("unit"), "begin", "end", "fits", path.alias("path"), head.alias("head"))
    read = read.withColumn("of", F.last(F.when(chosen, mine), ignorenulls=True).over(upto))
    inside = (F.col("at") >= F.col("of.begin")) & (F.col("at") < F.col("of.end"))
    members = read.where(inside).groupBy("row", "of.unit").agg(
        F.first("document_id").alias("document_id"),
        F.first("of").alias("of"),
        F.array_sort(F.collect_list(F.struct("k", "full"))).alias("tokens"),
    )
    raw = trimmed(F.array_join(F.transform("tokens", lambda t: t["full"]), ""))
    texts = F.when(F.col("of.fits"), F.array(F.concat("of.head", raw))).otherwise(hard_split(raw, limits.fill))
    pieces = F.transform(texts, lambda t: F.struct(t, F.col("of.path"), F.lit("json")).cast(PIECE))
    return members.select("row", "document_id", "unit", pieces.alias("pieces"))


def code_chunks(sources: DataFrame, id_col: str, text_col: str, language_col: str, limits: Limits | None = None) -> DataFrame:
    """(document_id, chunk_index, content, character_count, language, symbol, symbol_type) of every source."""
    limits = limits or Limits()
    sources = sources.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(language_col).alias("language"))
    is_json = F.coalesce((F.col("language") == "json") & is_container(F.col("text")), F.lit(False))
    units = units_of(sources.where(~is_json), "id", "text", "language")
    own = let(symbol_of(F.col("text"), F.col("language")), lambda s: F.transform(
        unit_pieces(F.col("text"), limits.fill), lambda t: F.struct(t.alias("text"), s["symbol"].alias("symbol"), s["symbol_type"].alias("symbol_type"))
    ))
    lines = F.transform(hard_split(F.col("text"), limits.fill), lambda t: F.struct(t, F.lit(""), F.lit("")).cast(PIECE))
    pieces = units.select(
        "row", "document_id", "language", "unit", F.when(F.col("language") == "jsonl", lines).otherwise(own.cast(f"array<{PIECE}>")).alias("pieces")
    )
    members = json_pieces(sources.where(is_json), "id", "text", limits)
    gap = F.when(F.col("language") == "jsonl", "\n").otherwise(GAP)
    return chunks_of(pieces, gap, limits).unionByName(chunks_of(members.withColumn("language", F.lit("json")), F.lit("\n"), limits))


def chunks_of(pieces: DataFrame, gap: Column, limits: Limits) -> DataFrame:
    """Packed chunks of (row, document_id, language, unit, pieces)."""
    whole = pieces.groupBy("row", "document_id", "language").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("unit", "pieces"))), lambda u: u["pieces"])).alias("pieces")
    )
    chunks = whole.withColumn("gap", gap).select(
        "document_id", "language", F.posexplode(F.filter(packed_code(limits), lambda c: trimmed(c["body"]) != "")).alias("chunk_index", "c")
    )
    mixed = F.col("c.mixed")
    return chunks.select(
        "document_id", "chunk_index", trimmed(F.col("c.body")).alias("content"),
        F.char_length(trimmed(F.col("c.body"))).alias("character_count"), "language",
        F.when(mixed, "").otherwise(F.left("c.symbol", F.lit(MOST_HEADING))).alias("symbol"),
        F.when(mixed, "").otherwise(F.col("c.symbol_type")).alias("symbol_type"),
    )


def classified(docs: DataFrame, text_col: str, path_col: str) -> DataFrame:
    """``docs`` with ``class``, what each text is, stored, since that is costly to tell."""
    # Telling what a text is costs more than moving it, and files may be few.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(docs.repartition(parts).withColumn("class", K.classify(F.col(text_col), F.col(path_col))), "classified")


def split_documents(docs: DataFrame, id_col: str, text_col: str, path_col: str, limits: Limits | None = None) -> DataFrame:
    """Chunks of code and of documents by what a text is, with ``content_type``."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(path_col).alias("path"))
    return split_classified(classified(rows, "text", "path"), limits)


def split_classified(found: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Chunks of the rows (id, text, class) of a stored table, which both ways read."""
    found = found.select("id", "text", "class.language", "class.kind")
    code = code_chunks(found.where("kind = 'code'"), "id", "text", "language", limits)
    code = code.withColumns({"content_type": F.lit("code"), "heading": F.lit(""), "section_path": F.lit("")})
    # The id takes the kind along.
    other = chunk_documents(found.where("kind <> 'code'").withColumn("id", F.struct("id", "kind")), "id", "text", limits)
    other = other.withColumns({"content_type": F.col("document_id.kind"), "document_id": F.col("document_id.id")})
    return other.withColumns({c: F.lit("") for c in ("language", "symbol", "symbol_type")}).unionByName(code)
