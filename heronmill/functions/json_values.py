"""JSON documents held as text: merges, deletions, slices and checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ANY = "map<string,variant>"


def members(json: Column) -> Column:
    """An object's members; none for what is not an object."""
    return F.coalesce(F.from_json(json, ANY), F.from_json(F.lit("{}"), ANY))


def merged(base: Column, patch: Column) -> Column:
    """Members of both, those of ``patch`` winning, in order of the keys."""
    mine, new = F.map_entries(members(base)), F.map_entries(members(patch))
    keys = members(patch)
    kept = F.filter(mine, lambda e: ~F.map_contains_key(keys, e["key"]))
    return rendered(F.concat(kept, new))


def without_keys(base: Column, *gone: str) -> Column:
    """Members without some keys."""
    return rendered(F.filter(F.map_entries(members(base)), lambda e: ~e["key"].isin(*gone)))


def rendered(entries: Column) -> Column:
    """Members as JSON text in order of their keys."""
    pairs = F.transform(
        F.array_sort(F.transform(entries, lambda e: F.struct(e["key"].alias("k"), F.to_json(e["value"]).alias("v")))),
        lambda e: F.concat(F.to_json(F.array(e["k"])).substr(F.lit(2), F.char_length(F.to_json(F.array(e["k"]))) - 2), F.lit(":"), e["v"]),
    )
    return F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))


def object_slice(text: Column) -> Column:
    """From the first ``{`` to the last ``}``."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit(""))


def array_slice(text: Column) -> Column:
    """From the first ``[`` to the last ``]``."""
    return F.nullif(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit(""))


def is_container(text: Column) -> Column:
    """Whether a text is one JSON object or array and nothing else.

    The parser stops behind the first value. What follows it would have to close or to go on with an array as well
    as an object, which only white space does.
    """
    alone = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))).isNotNull()
    inside = F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).isNotNull()
    return F.coalesce(F.when(text.rlike(r"^\s*[{\[]"), alone & inside & F.try_parse_json(text).isNotNull()), F.lit(False))


def is_json_lines(text: Column) -> Column:
    """Whether at least two lines are not blank and all of those are containers."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return (F.size(lines) >= 2) & F.forall(lines, is_container)
