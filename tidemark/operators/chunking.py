"""Documents into chunks, and the validity windows of their editions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_SEP = "\x1f"


def header_field(text: Column, label: str) -> Column:
    """The value of a ``LABEL: value`` line, '' where there is none; the first counts."""
    return F.trim(F.regexp_extract(text, rf"(?m)^{label}:[ \t]*([^\r\n]*)", 1))


def required_header(text: Column, label: str) -> Column:
    """Like :func:`header_field`, an error where the line is missing."""
    found = header_field(text, label)
    return F.when(found != "", found).otherwise(F.raise_error(F.lit(f"no {label} line")))


def pack_paragraphs(text: Column, size: int, sep: str = "\n") -> Column:
    """Paragraphs packed greedily into chunks of at most ``size`` characters (separators not
    counted); a longer paragraph is a chunk of its own.  Blank paragraphs are dropped."""
    parts = F.filter(F.transform(F.split(text, sep), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    # the fold keeps finished chunks in an array, and the open chunk with the characters in it
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("cur"), F.lit(0).alias("used"))

    def add(acc: Column, p: Column) -> Column:
        fits = (acc["used"] == 0) | (acc["used"] + F.length(p) <= size)
        return F.struct(
            F.when(fits, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["cur"]))).alias("done"),
            F.when(acc["used"] == 0, p).when(fits, F.concat(acc["cur"], F.lit(sep), p)).otherwise(p).alias("cur"),
            F.when(fits, acc["used"] + F.length(p)).otherwise(F.length(p)).alias("used"),
        )

    return F.aggregate(parts, zero, add, lambda acc: F.when(acc["used"] > 0, F.concat(acc["done"], F.array(acc["cur"]))).otherwise(acc["done"]))


def pack_with_lines(text: Column, size: int) -> Column:
    """Chunks with the number of the line they start at, as ``(chunk, line)``.

    Paragraphs are runs of lines that are not blank; they are packed greedily, two line ends
    between, as long as the open chunk and the next paragraph have at most ``size`` characters.
    """
    strip = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    none = F.array().cast("array<struct<chunk: string, line: int>>")
    one = lambda c, n: F.array(F.struct(c.alias("chunk"), n.alias("line")))
    closed = lambda acc: F.when(acc["cur"] != "", F.concat(acc["done"], one(acc["cur"], acc["start"]))).otherwise(acc["done"])
    zero = F.struct(none.alias("done"), F.lit("").alias("cur"), F.lit(0).alias("start"), F.lit(0).alias("i"))

    def line(acc: Column, x: Column) -> Column:
        blank, fresh = strip(x) == "", acc["cur"] == ""
        done = F.when(blank & ~fresh, F.concat(acc["done"], one(strip(acc["cur"]), acc["start"]))).otherwise(acc["done"])
        cur = F.when(blank, F.lit("")).when(fresh, x).otherwise(F.concat(acc["cur"], F.lit("\n"), x))
        return F.struct(done.alias("done"), cur.alias("cur"), F.when(fresh, acc["i"] + 1).otherwise(acc["start"]).alias("start"), (acc["i"] + 1).alias("i"))

    def paragraph(acc: Column, p: Column) -> Column:
        fresh = acc["cur"] == ""
        full = ~fresh & (F.length(acc["cur"]) + F.length(p["chunk"]) > size)
        cur = F.when(fresh | full, p["chunk"]).otherwise(F.concat(acc["cur"], F.lit("\n\n"), p["chunk"]))
        done = F.when(full, F.concat(acc["done"], one(acc["cur"], acc["start"]))).otherwise(acc["done"])
        return F.struct(done.alias("done"), cur.alias("cur"), F.when(fresh | full, p["line"]).otherwise(acc["start"]).alias("start"), acc["i"].alias("i"))

    paragraphs = F.aggregate(F.split(text, "\n"), zero, line, lambda acc: F.when(acc["cur"] != "", F.concat(acc["done"], one(strip(acc["cur"]), acc["start"]))).otherwise(acc["done"]))
    return F.aggregate(paragraphs, zero, paragraph, closed)


def fixed_windows(text: Column, size: int = 400, overlap: int = 50) -> Column:
    """Windows of ``size`` characters every ``size - overlap``, trimmed, empty ones dropped."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size - overlap))
    return F.filter(F.transform(starts, lambda i: F.regexp_replace(F.substring(text, i + 1, F.lit(size)), r"^\s+|\s+$", "")), lambda w: w != "")


def numbered(df: DataFrame, key: str, chunks: Column) -> DataFrame:
    """``(key, pos, chunk)``, one row per chunk."""
    return df.select(key, F.posexplode(chunks).alias("pos", "chunk"))


def clause_sections(text: Column) -> Column:
    """The text cut before every line that starts with ``CLAUSE n``; blank sections dropped."""
    parts = F.transform(F.split(text, r"(?m)^(?=CLAUSE\s+\d)"), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda p: p != "")


def structure_chunks(df: DataFrame, key: str, text: str) -> DataFrame:
    """``(key, section, row, chunk)``: a chunk per clause, and per table row the row under its
    clause's heading.  ``row`` is 0 for the clause's own text."""
    sections = df.select(key, F.posexplode(clause_sections(F.col(text))).alias("section", "body"))
    lines = F.split("body", "\r?\n")
    is_row = lambda x: x.rlike(r"^\s*\|\s*E-\d")
    prose = F.array_join(F.filter(lines, lambda x: ~is_row(x)), "\n")
    rows = F.transform(F.filter(lines, is_row), lambda x: F.concat_ws("\n", F.element_at(lines, 1), F.trim(x)))
    return sections.select(key, "section", F.posexplode(F.concat(F.array(prose), rows)).alias("row", "chunk"))


def validity_windows(editions: DataFrame, key: str, start: str) -> DataFrame:
    """Adds ``valid_to``: the day before the key's next distinct start, null for the last one."""
    over = Window.partitionBy(key).orderBy(start)
    steps = editions.select(key, start).distinct().withColumn("valid_to", F.date_sub(F.lead(start).over(over), 1))
    return editions.join(steps, [key, start], "left")
