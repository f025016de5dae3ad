"""Kind and language of a text by an ordered cascade of Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from heronmill.functions.folds import BLANKS, let, trimmed
from heronmill.functions.json_values import is_container, is_json_lines
from heronmill.sources.text_files import extension

#: Languages that an extension settles.
LANGUAGES = {
    "go": "go", "py": "python", "js": "javascript", "ts": "typescript", "java": "java", "rs": "rust", "sh": "shell",
    "sql": "sql", "json": "json", "jsonl": "jsonl", "ndjson": "jsonl", "c": "c", "cpp": "cpp", "cs": "csharp", "rb": "ruby", "php": "php",
    "kt": "kotlin", "swift": "swift", "yaml": "yaml", "yml": "yaml", "toml": "toml", "css": "css", "html": "html",
}


#: Words that begin lines of code.
KEYWORDS = (
    "func", "def", "class", "interface", "struct", "enum", "typedef",
    "import", "from", "using", "namespace", "package", "module",
    "public", "private", "protected", "static", "final", "abstract",
    "void", "int", "char", "float", "double", "bool", "string", "long", "short", "unsigned",
    "var", "let", "const", "fn", "impl", "trait", "type", "map", "range",
    "return", "if", "else", "for", "while", "switch", "case", "break", "continue",
    "try", "catch", "throw", "new", "delete", "sizeof", "printf", "cout", "endl",
    "include", "export", "async", "await", "lambda", "go", "defer", "select",
)
#: The share of lines from which a feature votes, and its votes; stops of Chinese prose; votes that make code.
VOTES = {"keyword": (0.2, 2), "brace": (0.2, 1), "indent": (0.3, 1), "comment": (0.1, 1), "semicolon": (0.2, 1)}
#: A line with a feature besides its first word; without any the votes cannot suffice.
CODE_LINE = r"(?m)^[ \t]|^\s*[}#*/]|[{;]\s*$"
STOPS, MOST_STOPS, STOPS_VOTE, CODE_VOTES = "。！？；", 3, -2, 4


def line_ratios(text: Column) -> Column:
    """Shares of the lines that are not blank: begun by a keyword, with a brace at an end, indented, comments, ended by a semicolon."""

    def of(line: Column) -> Column:
        bare = trimmed(line)
        word = F.lower(F.ltrim(F.regexp_extract(bare, r"^[^ \t(]*", 0), F.lit("#")))
        return F.struct(
            word.isin(*KEYWORDS).alias("keyword"), (bare.endswith("{") | bare.startswith("}")).alias("brace"),
            line.rlike("^[ \t]").alias("indent"), bare.rlike(r"^(?://|#|/?\*)").alias("comment"), bare.endswith(";").alias("semicolon"),
        )

    def shares(lines: Column) -> Column:
        n = F.size(lines)
        part = lambda name: F.when(n > 0, F.size(F.filter(lines, lambda f: f[name])) / n).otherwise(0.0).alias(name)
        return F.struct(*map(part, VOTES))

    solid = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{BLANKS}]"))
    return let(F.transform(solid, of), shares)


def code_score(text: Column) -> Column:
    """Votes of the features, less those of Chinese prose."""

    def votes(shares: Column) -> Column:
        total = F.lit(0)
        for name, (least, n) in VOTES.items():
            total = total + F.when(shares[name] >= least, n).otherwise(0)
        return total

    stops = F.char_length(text) - F.char_length(F.translate(text, STOPS, ""))
    return let(line_ratios(text), votes) + F.when(stops >= MOST_STOPS, STOPS_VOTE).otherwise(0)


def signs(text: Column, *patterns: str) -> Column:
    """How many of the patterns a text has."""
    total = F.lit(0)
    for p in patterns:
        total = total + text.rlike("(?m)" + p).cast("int")
    return total


def holds(text: Column, *words: str) -> Column:
    """Whether a text has one of the words, which is told much faster than by a pattern."""
    return reduce(or_, (F.contains(text, F.lit(w)) for w in words))


def language_signs(text: Column) -> Column:
    """The first language whose signs suffice, or null.

    A pattern is sought only in texts with a word that it needs.
    """

    def led(needs: Column, first: str, *more: str) -> Column:
        """One for the first pattern and one for each further one; nothing, and no further search, without the first."""
        return F.when(needs & text.rlike("(?m)" + first), 1 + signs(text, *more)).otherwise(0)

    def some(needs: Column, any_of: str, *patterns: str) -> Column:
        """How many of the patterns a text has that holds ``any_of``, which all of them need."""
        return F.when(needs & text.rlike("(?m)" + any_of), signs(text, *patterns)).otherwise(0)

    go = some(
        holds(text, "package ", "func ", "import ", "type "),
        r"^(?:package|func|import|type) ",
        r"^package [a-z]\w*\s*$", r"^func (?:\([^)]*\) )?\w+\(", r"^import (?:\(|\")", r"^type \w+ (?:struct|interface)\b",
    )
    python = led(holds(text, "def ", "class "), r"^(?:def|class) \w+[^\n]*:\s*$", r"^(?:import|from) \w", r"^ {4}\S[^\n]*:\s*$", r"^if __name__ ==")
    script = led(holds(text, "function", "=>"), r"\bfunction\b[^\n]*\(|=>", r"^\s*(?:const|let|var) \w+ =", r"\bconsole\.log\(", r"^(?:import|export) ", r";\s*$")
    java = led(
        holds(text, "{"),
        r"\b(?:class|interface|enum) \w+[^\n]*\{",
        r"^import [\w.]+;", r"\bpublic (?:static|class|void)\b", r"^package [\w.]+;", r"\bSystem\.out\b",
    )
    rust = led(holds(text, "fn ") & holds(text, "{"), r"\bfn \w+[^\n]*\{", r"\blet (?:mut )?\w+", r"^(?:use|mod|impl|pub) ")
    # Three of its five signs are asked for, and these words are needed by all but two.
    shell = some(
        holds(text, "#!", "$", "then"),
        r"^#!|^\s*(?:fi|done|esac|echo|export|cd)\b|\$|\bthen\b",
        r"^#!.*\bsh\b", r"^\s*(?:fi|done|esac)\b", r"\$\{?\w+", r"^\s*(?:echo|export|cd) ", r"\bthen\b",
    )
    sql = led(holds(F.lower(text), "select"), r"(?i)\bselect\b[^;]+\bfrom\b", r"(?i)\b(?:where|group by|order by|join)\b")
    return (
        F.when(go >= 2, "go").when(python >= 2, "python").when(script >= 2, "javascript").when(java >= 2, "java")
        .when(rust >= 2, "rust").when(shell >= 3, "shell").when(sql >= 2, "sql")
    )


def classify(text: Column, path: Column) -> Column:
    """(kind, language, reason) of a document."""
    ext = extension(F.coalesce(path, F.lit("")))
    by_extension = F.lit(None).cast("string")
    for name, language in LANGUAGES.items():
        by_extension = F.when(ext == name, language).otherwise(by_extension)

    def row(kind: str, language: Column, reason: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), language.alias("language"), F.lit(reason).alias("reason"))

    none = F.lit(None).cast("string")

    def by_content(found: Column) -> Column:
        return (
            F.when(found == "go", row("code", found, "signs"))
            .when(is_container(text), row("code", F.lit("json"), "json"))
            .when(is_json_lines(text), row("code", F.lit("jsonl"), "json"))
            .when(holds(text, "```", "~~~") & text.rlike(r"(?m)^[ \t]*(?:```|~~~)"), row("document", none, "fence"))
            .when(found.isNotNull(), row("code", found, "signs"))
            .when(text.rlike(CODE_LINE) & (code_score(text) >= CODE_VOTES), row("code", none, "score"))
            .when(holds(text, "#") & text.rlike(r"(?m)^#{1,6}(?:[ \t]|$)"), row("document", none, "heading"))
            .otherwise(row("plain_text", none, "default"))
        )

    return (
        F.when(ext.isin("md", "markdown"), row("document", none, "extension"))
        .when(by_extension.isNotNull(), row("code", by_extension, "extension"))
        .otherwise(let(language_signs(text), by_content))  # the signs are sought once
    )
