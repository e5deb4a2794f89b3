"""Boxes, words and spans of pages: reading order, rows, headings, superscripts, printed numbers and codes.

All take tables that a page reader has made; a page is a small group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

LANES = ("full", "left", "right")
#: How far a wide box reaches on either side of the middle; the height of a row of words; how much
#: smaller and higher a superscript is; the lowest part and right half of a page that hold its code.
WIDE = (0.55, 1.35)
ROW_TOLERANCE = 8.0
SMALLER, HIGHER = 0.85, 0.6
CORNER = (0.5, 0.85)
CODE = r"^[A-Z]+(-[A-Z])?(-\d+[A-Z]?)?( \d+ OF \d+)?$"


def lane(x0: Column, x1: Column, middle: Column) -> Column:
    """full for a box that spans both columns of a page, else left or right by its centre."""
    wide = (x0 < middle * WIDE[0]) & (x1 > middle * WIDE[1])
    return F.when(wide, "full").when((x0 + x1) / 2 <= middle, "left").otherwise("right")


def reading_order(blocks: DataFrame, middle: Column) -> DataFrame:
    """blocks: ``page``, ``block_id``, ``x0``, ``y0``, ``x1``. Adds ``lane`` and
    ``place`` on the page: wide blocks first, then the left column, then the right."""
    rows = blocks.withColumn("lane", lane(F.col("x0"), F.col("x1"), middle))
    number = F.array_position(F.array(*map(F.lit, LANES)), F.col("lane"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("page").orderBy(number, "y0", "block_id")))


def row_groups(words: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """words: ``page``, ``word_id``, ``x0``, ``y0``. Adds ``row``: words go top
    down, and one belongs to the row while it is no further than ``tolerance``
    from the row's height, which drifts halfway to each word."""

    return rows_of_pages(words.select("page", "word_id", "x0", "y0"), tolerance)


def rows_of_pages(words: DataFrame, tolerance: float = ROW_TOLERANCE) -> DataFrame:
    """``row_groups`` beside all other columns. Words are dealt by page and gone
    through in order, so a task holds a batch of them and one height, not a page."""
    order = [F.asc_nulls_last("__band"), F.asc_nulls_last("x0"), "word_id"]
    words = words.withColumn("__band", F.rint(F.col("y0") / tolerance) * tolerance)
    words = words.repartition("page").sortWithinPartitions("page", *order).drop("__band")
    return words.mapInArrow(_rows(tolerance), StructType([*words.schema.fields, StructField("row", IntegerType())]))


def _rows(tolerance: float) -> Callable:
    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, started, row, height = None, False, 0, 0.0
        for batch in batches:
            if not batch.num_rows:
                continue
            pages = batch.column(batch.schema.get_field_index("page"))
            codes = pages.dictionary_encode(null_encoding="encode").indices.to_numpy()
            new = np.append(not started or pages[0].as_py() != page, codes[1:] != codes[:-1])
            rows = []
            for y, first in zip(batch.column(batch.schema.get_field_index("y0")).cast(pa.float64()).to_numpy(zero_copy_only=False).tolist(), new.tolist(), strict=True):
                if first:
                    row, height = 0, y
                elif abs(y - height) <= tolerance:
                    height = (height + y) / 2
                else:
                    row, height = row + 1, y
                rows.append(row)
            page, started = pages[-1].as_py(), True
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.int32())], [*batch.schema.names, "row"])

    return number


def is_capital_heading(line: Column) -> Column:
    return line.rlike(r"[A-Z]{2}") & ~line.rlike(r"\p{Ll}")


def merge_headings(units: DataFrame, longest: int = 60) -> DataFrame:
    """units: ``doc_id``, ``pos``, ``page``, ``text``, ``is_heading``. Headings in
    capitals that follow each other on a page are one, wrapped: a row per unit
    that is left, with the first ``pos`` and the joined ``text``."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    capital = F.col("is_heading") & is_capital_heading(F.split_part("text", F.lit("\n"), F.lit(1)))
    rows = units.withColumn("capital", F.coalesce(capital, F.lit(False)))
    follows = F.col("capital") & F.lag("capital").over(order) & (F.col("page") == F.lag("page").over(order)) & (F.length(F.split_part("text", F.lit("\n"), F.lit(1))) < longest)
    rows = rows.withColumn("new", (~F.coalesce(follows, F.lit(False))).cast("int"))
    rows = rows.withColumn("group", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.sort_array(F.collect_list(F.struct("pos", "text")))
    merged = rows.groupBy("doc_id", "group").agg(F.min("pos").alias("pos"), F.first("page").alias("page"), F.first("is_heading").alias("is_heading"), parts.alias("parts"))
    heads = F.transform("parts", lambda p: F.trim(F.split_part(p["text"], F.lit("\n"), F.lit(1))))
    rest = F.filter(F.transform("parts", lambda p: F.trim(F.regexp_replace(p["text"], r"^[^\n]*\n?", ""))), lambda t: t != "")
    joined = F.array_join(F.concat(F.array(F.array_join(heads, " ")), rest), "\n")
    text = F.when(F.size("parts") > 1, joined).otherwise(F.get("parts", F.lit(0))["text"])
    return merged.select("doc_id", "pos", "page", "is_heading", text.alias("text"))


def superscripts(spans: DataFrame, smaller: float = SMALLER, higher: float = HIGHER) -> DataFrame:
    """spans: ``line_id``, ``span_id``, ``size``, ``y``, ``text``. Those that are
    clearly smaller than most of their line, stand above its base and read as numbers."""
    line = Window.partitionBy("line_id")
    rows = spans.withColumns({"usual": F.median("size").over(line), "base": F.median("y").over(line)})
    number = F.replace(F.trim("text"), F.lit(" "), F.lit("")).rlike(r"^\d{1,3}([,–-]\d{1,3})*,?$")
    return rows.filter((F.col("size") > 0) & (F.col("size") < F.col("usual") * smaller) & (F.col("y") < F.col("base") - higher) & number).drop("usual", "base")


def printed_offset(pages: DataFrame, is_first: Column, default: int = 0, most: int = 5) -> DataFrame:
    """pages: ``doc_id``, ``page``, ``text``. By how much a document's page
    numbers are ahead of the printed ones: told by the last line of digits (1 to
    ``most``) on the first page where ``is_first`` holds, taken as 1 if it has none."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d{1,4}$"))
    inside = F.filter(F.transform(lines, lambda x: x.cast("int")), lambda n: n.between(1, most))
    found = pages.withColumn("ahead", F.when(is_first, F.col("page") - F.coalesce(F.get(inside, F.size(inside) - 1), F.lit(1))))
    first = F.min(F.when(is_first, F.struct("page", "ahead")))
    return found.groupBy("doc_id").agg(F.coalesce(first["ahead"], F.lit(default)).alias("ahead"))


def footer_codes(blocks: DataFrame, width: Column, height: Column, code: str = CODE) -> DataFrame:
    """blocks: ``page``, ``block_id``, ``x0``, ``y0``, ``text``. A page's code: the
    first block in its lower right corner (lowest 15 %, right half) that reads as one."""
    text = F.regexp_replace(F.trim("text"), r"\s+", " ")
    corner = (F.col("y0") >= height * CORNER[1]) & (F.col("x0") >= width * CORNER[0]) & text.rlike(code)
    return blocks.filter(corner).groupBy("page").agg(F.min_by(text, "block_id").alias("code"))
