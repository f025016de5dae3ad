"""The chunking plan against a chunker that reads texts line by line and builds the tree."""

import random
import re

import pytest

from heronmill.functions.folds import BLANKS
from heronmill.operators.chunks import Limits, chunk_documents
from heronmill.operators.sections import section_tree

ENDS = "。！？；…\n.!?;"


def strip(s):
    return s.strip(BLANKS)


def normal(text):
    text = text.removeprefix("﻿").replace("\r\n", "\n").replace("\r", "\n")
    lines = text.split("\n")
    if lines[0].rstrip(" \t") == "---":
        close = next((i for i in range(1, len(lines)) if lines[i].rstrip(" \t") == "---"), 0)
        lines = lines[close + 1 :]
    return lines


def cells(line):
    inner = strip(line).replace("\\|", "").strip(" \t")
    return len(re.sub(r"^\||\|$", "", inner).split("|")) if "|" in inner else 0


def ruled_cells(line):
    bare = re.sub("[ \t]", "", line)
    parts = re.sub(r"^\||\|$", "", bare).split("|")
    ok = re.fullmatch(r"[|:-]+", bare) and "|" in bare and all(re.fullmatch(":?-+:?", c) for c in parts)
    return len(parts) if ok else 0


class Node:
    def __init__(self, level=0, heading="", path=""):
        self.level, self.heading, self.path = level, heading, path
        self.blocks, self.parts = [], []

    def all_blocks(self):
        return self.blocks + [b for p in self.parts for b in p.all_blocks()]

    def size(self):
        sizes = [len(t) for t, _ in self.all_blocks()]
        return sum(sizes) + 2 * max(0, len(sizes) - 1)


def tree(text):
    """A reader with a state: the open block, the list it is in, and what the last lines were."""
    root = Node()
    stack = [root]
    lines = normal(text)
    block, whole = None, False
    listed = ""  # sign of the list that the last line at the margin began
    last = None  # kind of the last line
    last_solid_code = False  # whether the last line that is not blank was indented code

    def close():
        nonlocal block
        if block is not None and strip("\n".join(block)):
            stack[-1].blocks.append((strip("\n".join(block)), whole))
        block = None

    i = 0
    while i < len(lines):
        line = lines[i]
        fence = re.match(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})", line)
        if fence:
            close()
            mark = fence[1]
            j = i + 1
            while j < len(lines):
                end = re.match(r" {0,3}(`{3,}|~{3,})[ \t]*$", lines[j])
                if end and end[1].startswith(mark):
                    break
                j += 1
            if any(map(strip, lines[i + 1 : j])) or (j < len(lines) and lines[i + 1 : j]):
                block, whole = lines[i : j + 1], True
                close()
            i, last, listed, last_solid_code = j + 1, "code", "", False
            continue
        indent = len(line.replace("\t", "    ")) - len(line.replace("\t", "    ").lstrip(" "))
        bare = re.sub("[ \t]", "", line)
        blank = not strip(line)
        inside = not blank and indent >= 2 and listed != ""
        heading = re.match(r" {0,3}(#{1,6})(?:[ \t]|$)", line)
        ruled = re.match(r" {0,3}\S", line) and re.fullmatch(r"\*{3,}|-{3,}|_{3,}", bare)
        item = None if ruled else re.match(r" {0,3}([-+*]|[0-9]{1,9}[.)])(?:[ \t]|$)", line)
        sign = item[1][-1] if item else ""
        quote = re.match(" {0,3}>", line) is not None
        was_list = listed
        if not blank and indent < 2:
            listed = sign
        if blank:
            if block is not None:
                block.append(line)
            last = "blank"
            i += 1
            continue
        if heading and not inside:
            close()
            level = len(heading[1])
            title = strip(re.match(r" {0,3}#{1,6}(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", line)[1] or "")
            while len(stack) > 1 and stack[-1].level >= level:
                stack.pop()
            path = f"{stack[-1].path}/{title}" if stack[-1].path else title
            own = Node(level, title, path)
            stack[-1].parts.append(own)
            stack.append(own)
            last, last_solid_code = "heading", False
            i += 1
            continue
        if re.fullmatch(r" {0,3}(=+|-+)[ \t]*", line) and last == "prose" and not inside:
            last, last_solid_code = "lined", False
            i += 1
            continue
        if ruled and not inside:
            close()
            last, last_solid_code = "rule", False
            i += 1
            continue
        in_text = last in ("prose", "quote", "item", "inside", "deep", "ruled")
        deep = indent >= 4 and not inside
        set_in = deep and not in_text
        n = cells(line)
        table = n > 0 and i + 1 < len(lines) and not re.match(r" {0,3}(`{3,}(?=[^`]*$)|~{3,})", lines[i + 1]) and ruled_cells(lines[i + 1]) == n
        first = re.match(r" {0,3}(?:[-+*]|0{0,8}1[.)])(?:[ \t]|$)", line) is not None
        if last in (None, "code", "heading", "lined", "rule") or table or block is None:
            begins = True
        elif inside or (sign and was_list == sign):
            begins = False
        elif last == "blank":
            begins = not (set_in and last_solid_code)
        else:
            begins = bool(sign and was_list != sign and (first or last != "prose")) or (quote and last != "quote" and not last_quote) or (last == "set in" and not set_in)
        if begins:
            close()
            block, whole = [line], bool(set_in or table)
        else:
            block.append(line)
        last_quote = quote
        last_solid_code = set_in
        if set_in:
            last = "set in"
        elif inside:
            last = "inside"
        elif deep:
            last = "deep"
        elif item:
            last = "item"
        elif quote:
            last = "quote"
        elif ruled:
            last = "ruled"
        else:
            last = "prose"
        i += 1
    close()
    front = Node()
    front.blocks = root.blocks
    return ([front] if root.blocks else []) + root.parts


class Chunk:
    def __init__(self, node, parts):
        self.heading, self.path, self.seed, self.parts = node.heading, node.path, "", parts

    def content(self):
        out = self.seed
        for i, (text, gap) in enumerate(self.parts):
            out += ("\n\n" if self.seed else "") if i == 0 else gap
            out += text
        return strip(out)


def seed(text, limits, room):
    if room <= 0 or len(text) <= limits.overlap:
        return ""
    tail = text[len(text) - min(limits.overlap, room) :]
    at = next((i for i, c in enumerate(tail) if c in ENDS), None)
    return "" if at is None else strip(tail[at + 1 :])


def split_block(text, whole, limits):
    if len(text) <= limits.fill or (whole and len(text) <= 2 * limits.most):
        return [text]
    out, held = [], ""
    for s in re.findall(f"[^{ENDS}]*[{ENDS}]|[^{ENDS}]+$", text):
        if held and len(held) + len(s) > limits.fill:
            out.append(held)
            held = ""
        if len(s) > limits.fill:
            s = s.removesuffix("\n")
            out += [s[k : k + limits.fill] for k in range(0, len(s), limits.fill)]
        else:
            held += s
    return [*out, held]


def pack(node, limits):
    pieces = []
    for b, (text, whole) in enumerate(node.blocks):
        own = [t for t in split_block(text, whole, limits) if strip(t)]
        pieces += [(t, "\n\n" if b and not k else "") for k, t in enumerate(own)]
    chunks, held, size = [], [], 0
    for text, gap in pieces:
        gap_size = len(gap) if held else 0
        if held and size + gap_size + len(text) > limits.fill:
            chunks.append(Chunk(node, held))
            held, size, gap_size = [], 0, 0
        held.append((text, gap))
        size += gap_size + len(text)
    if held:
        chunks.append(Chunk(node, held))
    for before, c in zip(chunks, chunks[1:]):
        c.seed = seed(before.content(), limits, limits.most - len(c.content()))
    if len(chunks) > 1 and len(chunks[-1].content()) < limits.least:
        both = Chunk(node, chunks[-2].parts + chunks[-1].parts)
        both.seed = chunks[-2].seed
        if len(both.content()) <= limits.most + limits.overlap:
            chunks[-2:] = [both]
    return chunks


def join(groups, limits, inside):
    out = []
    for g in groups:
        if not g:
            continue
        if len(g) == 1 and out:
            small, before = g[0].content(), out[-1][-1]
            if (before.path or not g[0].path) and len(small) < limits.least and len(before.content()) + 2 + len(small) <= limits.most:
                before.parts = [*before.parts, (small, "\n\n")]
                continue
        out.append(g)
    if inside and len(out) > 1 and len(out[0]) == 1:
        small, target = out[0][0].content(), out[1][0]
        if len(small) < limits.least and len(small) + 2 + len(target.content()) <= limits.most:
            target.parts = [(small, ""), (target.parts[0][0], "\n\n"), *target.parts[1:]]
            out = out[1:]
    flat = []
    for g in out:
        if inside and flat:
            g[0].seed = seed(flat[-1].content(), limits, limits.most - len(g[0].content()))
        flat += g
    return flat


def emit(node, limits):
    if node.size() == 0:
        return []
    if node.size() <= limits.most:
        return [Chunk(node, [(t, "\n\n") for t, _ in node.all_blocks()])]
    return join([pack(node, limits), *(emit(p, limits) for p in node.parts)], limits, True)


def by_hand(text, limits):
    found = join([emit(n, limits) for n in tree(text)], limits, False)
    rows = [(strip(c.heading)[:300], strip(c.path)[:300], c.content()) for c in found if c.content()]
    return [(i, *r) for i, r in enumerate(rows)]


def prose(rnd, most):
    words = ["alpha", "beta", "gamma", "说明", "delta", "ε"]
    ends = [". ", "! ", "。", ", ", " ", " ", "; ", "…"]
    return strip("".join(rnd.choice(words) + rnd.choice(ends) for _ in range(rnd.randint(1, most))))


def markdown(seed_):
    """Texts of all kinds of lines, in and out of order."""
    rnd = random.Random(seed_)
    lines = []
    for _ in range(rnd.randint(1, 40)):
        kind = rnd.randint(0, 21)
        most = rnd.choice([3, 12, 60])
        if kind <= 4:
            lines.append(rnd.choice(["", " ", "  "]) * (rnd.random() < 0.2) + "#" * rnd.randint(1, 7) + rnd.choice([" ", " ", " ", ""]) + prose(rnd, 3) + rnd.choice(["", " ##"]))
        elif kind <= 6:
            lines += [rnd.choice(["```", "~~~", "````"]) + rnd.choice(["", "go", " a b"])] + [rnd.choice(["# no", "x = 1", "", "~~~", "    y"]) for _ in range(rnd.randint(0, 5))]
            lines += [rnd.choice(["```", "~~~", "````", "```", "``` x"])]
        elif kind == 7:
            lines += ["| a | b |", "| --- | :-: |"] + [f"| {prose(rnd, 2)} | 2 |" for _ in range(rnd.randint(0, 30))]
        elif kind == 8:
            lines += [rnd.choice(["    ", "\t"]) + prose(rnd, 4) for _ in range(rnd.randint(1, 3))]
        elif kind == 9:
            lines += [rnd.choice(["- ", "* ", "1. ", "2) ", "+ "]) + prose(rnd, 8), rnd.choice(["  # in it", "  more", "", "- next", "    far"])]
        elif kind == 10:
            lines += [prose(rnd, 5), rnd.choice(["===", "---", "  ----", "***"])]
        elif kind == 11:
            lines += ["> # " + prose(rnd, 3), rnd.choice(["> more", "lazy", ""])]
        elif kind == 12:
            lines.append(rnd.choice(["---", "***", "_ _ _", "- - -", "=="]))
        elif kind == 13:
            lines.append("长" * rnd.randint(1, 900))
        else:
            lines.append(prose(rnd, most))
        lines += [""] * rnd.choice([0, 1, 1, 2])
    head = rnd.choice([[], [], [], ["---", "title: x", "---"], ["---"], ["﻿"]])
    return rnd.choice(["\n", "\n", "\r\n"]).join([*head, *lines])


CASES = [
    "", "   ", "\n\n\n", "  \n\t\n  ", "﻿", None,
    "# 标题\n\n## 只有标题的小节\n\n### 另一个\n\n正文第一段。\n\n正文第二段。",
    "# 一\n\n" + "甲。" * 600 + "\n\n# 二\n\n" + "乙。" * 600,
    "开场白，没有标题。\n\n# 第一章 背景\n\n第一章的正文。\n\n## 1.1 细节\n\n细节的正文。",
    "#标签不是标题\n\nC# 是一门语言\n\n####### 七个井号不是标题",
    "# " + "长" * 400 + "\n\n正文。",
    "甲" * 700 + "\n\n" + "乙" * 50,
    "# 第一章\n\n" + "章首甲。" * 75 + "\n\n## 1.1 小节甲\n\n" + "乙。" * 450 + "\n\n## 1.2 小节乙\n\n" + "丙。" * 75,
    "# 第一页\n\n要点一。\n\n# 第二页\n\n要点二。\n\n# 第三页\n\n要点三。",
    "# 配置\n\n示例：\n\n    # 启动命令\n    python parse.py\n\n说明文字继续。",
    "文档标题\n========\n\n正文段落。\n\n小节标题\n--------\n\n小节的正文。",
    "# 主标题\n\n> # 引用里的标题\n> 引用正文。\n\n正常正文。\n",
]


@pytest.mark.parametrize("limits", [Limits(), Limits(200, 40, 50)])
def test_same_chunks_as_by_hand(spark, limits):
    texts = CASES + [markdown(s) for s in range(500)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    got: dict[int, list] = {}
    for r in chunk_documents(rows, "doc", "text", limits).collect():
        assert r.character_count == len(r.content)
        got.setdefault(r.document_id, []).append((r.chunk_index, r.heading, r.section_path, r.content))
    for i, text in enumerate(texts):
        assert sorted(got.get(i, [])) == by_hand(text or "", limits), text


def test_same_sections_as_by_hand(spark):
    texts = CASES + [markdown(s) for s in range(200)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    got: dict[int, list] = {}
    for r in section_tree(rows, "doc", "text").collect():
        got.setdefault(r.document_id, []).append((r.section, r.level, r.heading, r.section_path, r.chars))

    def walk(nodes):
        for n in nodes:
            if n.level and n.size():
                yield n.level, n.heading, n.path, n.size()
            yield from walk(n.parts)

    for i, text in enumerate(texts):
        assert [r[1:] for r in sorted(got.get(i, []))] == list(walk(tree(text or ""))), text


def test_rules_of_chunks(spark):
    texts = {
        0: "这是一句用来测试切分的长句子。" * 120,
        1: "甲" * 1000,
        2: "## 示例\n\n```go\n" + 'fmt.Println("hello world")\n' * 25 + "```\n",
        3: "## 表\n\n" + "\n".join(["| 字段 | 说明 |", "| --- | --- |", *["| 字段 | 说明文字 |"] * 40]),
        4: "\n".join(["| 字段 | 说明 |", "| --- | --- |", *["| 字段 | 说明文字 |"] * 200]),
    }
    rows = spark.createDataFrame(list(texts.items()), "doc long, text string").withColumnRenamed("text", "own text")
    chunks = chunk_documents(rows, "doc", "own text", Limits(400, 120, 100)).collect()
    of = {i: [c.content for c in sorted(chunks, key=lambda c: c.chunk_index) if c.document_id == i] for i in texts}
    assert all(len(c) <= 400 for i in (0, 1, 4) for c in of[i])
    assert "".join(of[1]) == texts[1]
    assert len(of[2]) == 1 and of[2][0].count("```") == 2
    assert of[3] == [texts[3].split("\n\n")[1]]
    assert of[0][1].startswith(of[0][0][-15:])


def test_repeated_ids_and_empty_tables(spark):
    rows = spark.createDataFrame([(1, "# a\n\nx."), (1, "# b\n\ny."), (None, "z."), (2, None)], "doc long, text string")
    got = sorted((str(r.document_id), r.chunk_index, r.heading, r.content) for r in chunk_documents(rows, "doc", "text").collect())
    assert got == [("1", 0, "a", "x."), ("1", 0, "b", "y."), ("None", 0, "", "z.")]
    assert chunk_documents(rows.limit(0), "doc", "text").count() == 0
