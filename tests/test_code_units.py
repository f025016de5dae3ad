"""Code units, JSON members and routing against loops over characters and a recursive reader."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from heronmill.functions.folds import BLANKS
from heronmill.operators import code_units as C
from heronmill.operators.chunks import Limits

LIMITS = [Limits(), Limits(200, 20, 1)]


def strip(s):
    return s.strip(BLANKS)


def depths(text, language):
    """Depth before each line, character by character."""
    block, depth, out = False, 0, []
    for line in text.split("\n"):
        out.append(depth)
        change, i, quote = 0, 0, ""
        while i < len(line):
            two = line[i : i + 2]
            if block:
                if two == "*/":
                    block, i = False, i + 1
            elif quote:
                if line[i] == "\\":
                    i += 1
                elif line[i] == quote:
                    quote = ""
            elif line[i] in "\"'`":
                quote = line[i]
            elif two == "//" or (line[i] == "#" and language in C.HASH_COMMENTS):
                break
            elif two == "/*":
                block, i = True, i + 1
            else:
                change += {"{": 1, "}": -1}.get(line[i], 0)
            i += 1
        depth = max(0, depth + change)
    return out


def units(text, language):
    lines, out, held = text.split("\n"), [], []
    if language == "jsonl":
        return [strip(x) for x in lines if strip(x)]

    def flush():
        if strip("\n".join(held)):
            out.append(strip("\n".join(held)))
        held.clear()

    if language in C.INDENTED:
        for line in lines:
            solid = [x for x in held if strip(x)]
            notes = bool(solid) and all(re.match(r"#|//|/?\*", strip(x)) for x in solid)
            if strip(line) and line[0] not in " \t" and held and not notes:
                flush()
            held.append(line)
    else:
        for line, depth in zip(lines, depths(text, language)):
            if not strip(line) and depth == 0 and held:
                flush()
            else:
                held.append(line)
    flush()
    return out


def hard(text, most):
    if len(text) <= most:
        return [text]
    out, held = [], ""
    for line in text.split("\n"):
        if held and len(held) + 1 + len(line) > most:
            out.append(held)
            held = ""
        while len(line) > most:
            out.append(line[:most])
            line = line[most:]
        if line:
            held = f"{held}\n{line}" if held else line
    return [x for x in [*out, held] if strip(x)]


def width(line):
    return sum(4 if c == "\t" else 1 for c in re.match("[ \t]*", line)[0])


def pieces(text, most):
    if len(text) <= most:
        return [text]
    first, *rest = text.split("\n")
    solid = [x for x in rest if strip(x)]
    if not solid:
        return hard(text, most)
    base, parts = min(map(width, solid)), [first]
    for line in rest:
        if strip(line) and width(line) == base:
            parts.append(line)
        else:
            parts[-1] += "\n" + line
    if len(parts) < 2:
        return hard(text, most)
    return [h for p in parts if strip(p) for h in hard(strip(p), most)]


def member_pieces(text, most, path="", depth=1):
    """Recursive, with the positions that the reader of the standard library gives."""
    reader, out, i, n = json.JSONDecoder(), [], 1, 0
    space = lambda j: re.compile(r"\s*").match(text, j).end()
    i = space(i)
    while text[i] not in "}]":
        head, name = "", f"{path}[{n}]"
        if text[0] == "{":
            _, end = reader.raw_decode(text, i)
            key = text[i:end]
            head, name = f"{key}: ", f"{path}.{key[1:-1]}" if path else key[1:-1]
            i = space(space(end) + 1)
        value, end = reader.raw_decode(text, i)
        raw = text[i:end]
        if len(head + raw) <= most:
            out.append((head + raw, name))
        elif isinstance(value, (dict, list)) and depth < C.MOST_DEPTH:
            out += member_pieces(raw, most, name, depth + 1)
        else:
            out += [(h, name) for h in hard(raw, most)]
        i, n = space(end), n + 1
        if text[i] == ",":
            i = space(i + 1)
    return out


def pack(parts, gap, limits):
    """Chunks of (text, symbol)."""
    chunks, held = [], []
    for text, symbol in parts:
        if held and len(gap.join(t for t, _ in held)) + len(gap) + len(text) > limits.fill:
            chunks.append(held)
            held = []
        held.append((text, symbol))
    chunks += [held] if held else []
    join = lambda c: strip(gap.join(t for t, _ in c))
    if len(chunks) > 1 and len(join(chunks[-1])) < limits.least and len(join(chunks[-2] + chunks[-1])) <= limits.most + limits.overlap:
        chunks[-2:] = [chunks[-2] + chunks[-1]]
    out = []
    for c in chunks:
        symbols = {s for _, s in c if s}
        out.append((join(c), symbols.pop() if len(symbols) == 1 else ""))
    return [(i, *c) for i, c in enumerate(x for x in out if x[0])]


def source(seed):
    rnd = random.Random(seed)
    bits = ["{", "}", '"', "'", "`", "//", "/*", "*/", "#", "\\", "x", " ", "y = 1", "\\\"", "/", "*", "{}", "  "]
    lines = []
    for _ in range(rnd.randint(0, 25)):
        kind = rnd.randint(0, 5)
        if kind == 0:
            lines.append("")
        elif kind == 1:
            lines.append(rnd.choice(["func f() {", "def g(x):", "class A:", "}", "    return 1", "\tx()", "# note", "// note", "type T struct {"]))
        else:
            lines.append(rnd.choice(["", "", "  ", "\t"]) + "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 9))))
        if rnd.random() < 0.1:
            lines.append("long " * rnd.randint(20, 250))
    return "\n".join(lines)


def table(spark, rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc long, code string, lang string")
    return df.withColumns({c: F.lit("extra") for c in ("row", "at", "line", "unit", "text", "language", "k", "token")})


LANGUAGES = ["go", "python", "shell", "java", "yaml", None, "jsonl"]


def test_depths(spark):
    rows = [(source(s), LANGUAGES[s % 7]) for s in range(400)]
    got: dict[int, list] = {}
    for r in C.read_lines(table(spark, rows), "doc", "code", "lang").collect():
        got.setdefault(r.document_id, []).append((r.at, r.depth))
    for i, (text, language) in enumerate(rows):
        assert [d for _, d in sorted(got[i])] == depths(text, language), text


@pytest.mark.parametrize("limits", LIMITS)
def test_chunks_of_code(spark, limits):
    rows = [(source(s), LANGUAGES[s % 7]) for s in range(300)] + [(None, "go"), ("", "go"), (" \n", None)]
    got: dict[int, list] = {}
    for r in C.code_chunks(table(spark, rows), "doc", "code", "lang", limits).collect():
        got.setdefault(r.document_id, []).append((r.chunk_index, r.content))
    for i, (text, language) in enumerate(rows):
        gap = "\n" if language == "jsonl" else "\n\n"
        cut = hard if language == "jsonl" else pieces
        parts = [(p, "") for u in units(text or "", language) for p in cut(u, limits.fill)]
        assert sorted(got.get(i, [])) == [c[:2] for c in pack(parts, gap, limits)], text


def value_of(rnd, depth):
    kind = rnd.randint(0, 6)
    if depth and kind <= 2:
        return {rnd.choice("abcde") + str(i): value_of(rnd, depth - 1) for i in range(rnd.randint(0, 5))}
    if depth and kind <= 4:
        return [value_of(rnd, depth - 1) for _ in range(rnd.randint(0, 5))]
    return rnd.choice([1, None, True, -2.5e3, "s", 'q"uo\\te', "{[,:]}", "长" * rnd.randint(1, 300), "é " * 40])


@pytest.mark.parametrize("limits", LIMITS)
def test_chunks_of_json(spark, limits):
    texts = []
    for s in range(200):
        rnd = random.Random(s)
        value = value_of(rnd, 5)
        value = value if isinstance(value, (dict, list)) else [value]
        texts.append(json.dumps(value, ensure_ascii=bool(s % 2), indent=rnd.choice([None, 1, 4])))
    deep = "x" * 900
    for _ in range(12):
        deep = {"d": deep}
    texts += [json.dumps(deep), "{}", "[ ]", '{"server": {"host": "0.0.0.0", "port": 8080}}']
    rows = table(spark, [(t, "json") for t in texts])
    got: dict[int, list] = {}
    for r in C.code_chunks(rows, "doc", "code", "lang", limits).collect():
        got.setdefault(r.document_id, []).append((r.chunk_index, r.content, r.symbol))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == pack(member_pieces(text, limits.fill), "\n", limits), text


def test_symbols_and_rules(spark):
    body = "\tvalue = value + 1\n" * 60
    go = "package main\n\ntype UserService struct {\n\trepo string\n}\n\nfunc (s *UserService) CreateUser(name string) error {\n" + body + "\treturn nil\n}\n"
    big = "package main\n\nfunc big() {\n" + "".join(f"\tx{i:03d} := {i}\n" for i in range(300)) + "}\n"
    python = (
        "import os\n\n# note\ndef load(path):\n    with open(path) as handle:\n        return handle.read()\n\n"
        'def save(path, data):\n    with open(path, "w") as handle:\n        handle.write(data)\n'
    )
    rows = table(spark, [(go, "go"), (big, "go"), (python, "python"), ('{"a": [1,', "json")])
    found = C.code_chunks(rows, "doc", "code", "lang", Limits(200, 20, 1)).collect()
    of = lambda i: [c for c in sorted(found, key=lambda c: c.chunk_index) if c.document_id == i]
    kinds = {(c.symbol, c.symbol_type) for c in of(0)}
    assert ("UserService.CreateUser", "method") in kinds and ("UserService", "struct") in kinds
    lines = {strip(x) for c in of(1) for x in c.content.split("\n")} - {"package main", "func big() {", "}", ""}
    assert lines == {f"x{i:03d} := {i}" for i in range(300)} and "}" in of(1)[-1].content
    load = next(c for c in of(2) if "def load" in c.content)
    assert "# note" in load.content and "return handle.read()" in load.content
    assert [c.content for c in of(3)] == ['{"a": [1,']
    assert C.code_chunks(rows.limit(0), "doc", "code", "lang").count() == 0


def test_routes(spark):
    go = "package main\n\nimport \"fmt\"\n\nfunc main() {\n\tfmt.Println(1)\n}\n"
    rows = spark.createDataFrame(
        [(0, go, None), (1, "# 标题\n\n正文段落。", "a.md"), (2, "一段普通文本。\n\n另一段。", "a.txt"), (3, '{"a": 1}', "x.json"), (4, None, None)],
        "doc long, text string, path string",
    )
    got = {r.document_id: (r.content_type, r.language, r.heading, r.symbol) for r in C.split_documents(rows, "doc", "text", "path").collect()}
    assert got == {0: ("code", "go", "", "main"), 1: ("document", "", "标题", ""), 2: ("plain_text", "", "", ""), 3: ("code", "json", "", "a")}
