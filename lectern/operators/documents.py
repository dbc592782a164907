"""Units of documents made in the engine: heading sections, row blocks, pages of rows, flat JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sections(texts: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, unit_no, level, label, start_line, lines): Markdown headings, each with the lines up to the next one. Texts without
    headings and null texts give none; line ends may be mixed."""
    lines = F.split(text, r"\r\n|\r|\n")
    head = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
    rows = texts.filter(F.col(text).isNotNull()).select(key, F.size(lines).alias("_n"), F.posexplode(lines).alias("_i", "_line")).filter(F.col("_line").rlike(head))
    w = W.partitionBy(key).orderBy("_i")
    end = F.coalesce(F.lead("_i").over(w), F.col("_n"))
    return rows.select(
        key, F.row_number().over(w).alias("unit_no"), F.length(F.regexp_extract("_line", head, 1)).alias("level"), F.regexp_extract("_line", head, 2).alias("label"),
        F.col("_i").alias("start_line"), (end - F.col("_i")).alias("lines"),
    )


def section_texts(texts: DataFrame, key: str = "file_id", text: str = "content") -> DataFrame:
    """The sections with their text, lines joined by line feeds."""
    lines = F.split(text, r"\r\n|\r|\n")
    own = texts.filter(F.col(text).isNotNull()).select(key, lines.alias("_lines"))
    rows = sections(texts, key, text).join(own, key)
    return rows.select(key, "unit_no", "label", F.array_join(F.slice("_lines", F.col("start_line") + 1, F.col("lines")), "\n").alias("content"))


def locate_units(units: DataFrame, phrases: list[str], most: int = 20, key: str = "file_id") -> DataFrame:
    """The first unit of each file that holds every phrase, whatever the case; the first ``most`` files have one. Each file's first unit is
    taken before the cut, so that no file's units use up the place of others. Phrases under three characters match nothing."""
    if not phrases or any(len(p) < 3 for p in phrases):
        return units.select(key, "unit_no", "label").limit(0)
    hit = F.lit(True)
    for p in phrases:
        hit &= F.contains(F.lower("content"), F.lit(p.lower()))
    top = F.min(F.struct("unit_no", "label")).alias("u")
    return units.filter(hit).groupBy(key).agg(top).select(key, "u.unit_no", "u.label").orderBy(key).limit(most)


def row_blocks(texts: DataFrame, size: int = 200, most: int = 20_000, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, block, first_row, rows, head): the non-blank lines of tables in blocks of ``size``. Lines beyond ``most`` are the
    reader's bound for previews."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    rows = texts.filter(F.col(text).isNotNull()).select(key, F.posexplode(lines).alias("_i", "_line")).filter(F.col("_i") < most)
    block = F.floor(F.col("_i") / size).cast("int")
    return rows.groupBy(key, block.alias("block")).agg(F.min("_i").alias("first_row"), F.count("*").alias("rows"), F.min_by("_line", "_i").alias("head"))


def row_page(texts: DataFrame, offset: int, limit: int, key: str = "file_id", text: str = "content", sep: str = r" \| ") -> DataFrame:
    """(key, r, c array<string>): one page of rows of each table with its cells."""
    lines = F.filter(F.split(text, r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    rows = texts.filter(F.col(text).isNotNull()).select(key, F.posexplode(F.slice(lines, offset + 1, limit)).alias("_i", "_line"))
    return rows.select(key, (F.col("_i") + offset).alias("r"), F.split("_line", sep).alias("c"))


def flat_json(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, k, v): the members of flat JSON objects as text; nulls and what is no object give no rows."""
    names = F.json_object_keys(text)
    each = rows.filter(F.col(text).isNotNull()).select(key, text, F.explode(names).alias("k"))
    return each.select(key, "k", F.expr(f"get_json_object(`{text}`, concat('$.', k))").alias("v")).filter("v is not null")


def window_of(texts: DataFrame, offset: int, size: int, key: str = "file_id", text: str = "content") -> DataFrame:
    """(key, part, more): a window of characters of each text."""
    return texts.filter(F.col(text).isNotNull()).select(key, F.substring(text, offset + 1, size).alias("part"), (F.length(text) > offset + size).alias("more"))
