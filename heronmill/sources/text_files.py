"""Text files as rows: decoding, routing by extension, content-addressed names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 32 * 1024 * 1024
#: Extensions that are read as text without another parser.
TEXT_EXTENSIONS = (
    "md", "markdown", "txt", "go", "py", "js", "ts", "jsx", "tsx", "java", "kt", "scala", "c", "h", "cc", "cpp", "hpp",
    "cs", "rs", "rb", "php", "swift", "sh", "bash", "sql", "json", "jsonl", "yaml", "yml", "toml", "ini", "css", "html",
    "xml", "vue", "lua", "pl", "r", "dart",
)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def parser_for(path: Column) -> Column:
    """``text``, ``document`` or null where nothing reads the file."""
    ext = extension(path)
    return F.when(ext.isin(*TEXT_EXTENSIONS), "text").when(ext.isin("pdf", "docx", "png", "jpg", "jpeg"), "document")


def decoded(content: Column) -> Column:
    """Bytes as text by their byte order mark, else as UTF-8; null if they are neither."""
    head = F.hex(F.substring(content, 1, 3))

    def utf16(kind: str) -> Column:
        body = F.substring(content, 3, 1 << 30)
        size = F.octet_length(body)
        return F.decode(F.substr(body, F.lit(1), size - size % 2), kind)  # an odd last byte goes

    return (
        F.when(head.startswith("EFBBBF"), F.try_validate_utf8(F.substring(content, 4, 1 << 30).cast("string")))
        .when(head.startswith("FFFE"), utf16("UTF-16LE"))
        .when(head.startswith("FEFF"), utf16("UTF-16BE"))
        .otherwise(F.try_validate_utf8(content.cast("string")))
    )


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error, digest) of the files under a path (A02); a bad file is a row, not a failure."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.regexp_replace(decoded(F.col("content")), "\r\n?", "\n")
    rows = files.select(
        "path",
        F.when(F.col("length") <= MOST_BYTES, text).alias("text"),
        F.sha2("content", 256).alias("digest"),
        "length",
    )
    error = (
        F.when(F.col("length") > MOST_BYTES, "size")
        .when(F.col("text").isNull(), "encoding")
        .when(F.trim("text") == "", "blank")
    )
    return rows.select("path", "text", error.alias("error"), "digest")


def content_name(digest: Column, path: Column) -> Column:
    """A name by content: the digest's beginning and the extension."""
    ext = extension(path)
    return F.concat(F.left(digest, F.lit(32)), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))


def markdown_table(rows: Column) -> Column:
    """Rows of cells as a table; null for fewer than two columns or no body."""
    cell = lambda c: F.replace(F.replace(F.trim(F.coalesce(c, F.lit(""))), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit("<br>"))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, cell), " | "), F.lit(" |"))
    head = F.transform(
        F.get(rows, F.lit(0)),
        lambda c, i: F.coalesce(F.nullif(F.trim(c), F.lit("")), F.concat(F.lit("列"), (i + 1).cast("string"))),
    )
    rule = F.concat(F.lit("| "), F.array_join(F.transform(head, lambda _: F.lit("---")), " | "), F.lit(" |"))
    body = F.transform(F.slice(rows, F.lit(2), F.size(rows)), line)
    whole = F.array_join(F.concat(F.array(line(head), rule), body), "\n")
    return F.when((F.size(head) >= 2) & (F.size(rows) >= 2), whole)


def bbox_overlap(ax0, ay0, ax1, ay1, bx0, by0, bx1, by1) -> Column:
    """Share of the first box that the second covers."""
    width = F.greatest(F.lit(0.0), F.least(ax1, bx1) - F.greatest(ax0, bx0))
    height = F.greatest(F.lit(0.0), F.least(ay1, by1) - F.greatest(ay0, by0))
    area = (ax1 - ax0) * (ay1 - ay0)
    return F.when(area > 0, width * height / area).otherwise(0.0)
