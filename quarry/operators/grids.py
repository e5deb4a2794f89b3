"""Tables from the words of a page, and which grids of cells are tables at all.

words: ``page``, ``word_id``, ``x0``, ``y0``, ``text``. A page is a small group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.layout import rows_of_pages

#: How far apart columns start, how few words are no table, and what heads of tables, notes,
#: references and table words in running text look like.
COLUMN_GAP = 45.0
LEAST_WORDS = 8
HEADER = r"(?i)(分期|分组|分层|推荐|评估|诊断|治疗|I\s*级|Ⅱ\s*级|Ⅲ\s*级|II\s*级|III\s*级)"
NOTE = r"^【?注释】?$"
LABEL = r"^\[[^\]]+\]$"
REFERENCES = (r"(?i)参考文献|et\s+al", r"(?i)doi|https?://|www\.|PMID")
REPEATED = (r"(?:19|20)\d{2}", r"\[\d{1,3}\]", r"[A-Z]{2,},?\s+[A-Z]\b")
TABLE_WORDS = r"级推荐|分层|分组|Ⅱ级|Ⅲ级|I级"
LONG_CELL, SHORT_CELL = 40, 20


def word_grid(words: DataFrame, gap: float = COLUMN_GAP, least: int = LEAST_WORDS) -> DataFrame:
    """``page`` and its ``grid``, an array of rows of cells, top down.

    Columns are the means of starts that lie within ``gap`` of each other; a word
    belongs to the nearest one, of equal ones to the left. Rows are those of
    ``layout.row_groups``. Words of a cell stand in order of ``x0`` and
    ``word_id``. Blank words and those without a place are left out; pages of
    fewer than ``least`` words or two columns have no grid.

    Words are read once and stay dealt by page from the columns to the grid."""
    words = words.filter(F.trim(F.coalesce("text", F.lit(""))) != "").filter("page is not null and word_id is not null and x0 is not null and y0 is not null").withColumn("text", F.trim("text"))
    page = Window.partitionBy("page")
    by_x = page.orderBy("x0")
    rows = rows_of_pages(words.select("page", "word_id", "x0", "y0", "text"))
    rows = rows.withColumn("new", (F.coalesce(F.col("x0") - F.lag("x0").over(by_x), F.lit(0.0)) > gap).cast("int"))
    rows = rows.withColumn("cluster", F.sum("new").over(by_x.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("centre", F.avg("x0").over(Window.partitionBy("page", "cluster")))
    rows = rows.withColumns({"centres": F.array_sort(F.collect_set("centre").over(page)), "n": F.count("*").over(page)})
    rows = rows.filter((F.col("n") >= least) & (F.size("centres") >= 2))
    near = F.array_min(F.transform("centres", lambda c, i: F.struct(F.abs(F.col("x0") - c).alias("far"), i.alias("at"))))["at"]
    cells = rows.groupBy("page", "row", near.alias("column")).agg(F.array_sort(F.collect_list(F.struct("x0", "word_id", "text"))).alias("w"), F.any_value(F.size("centres")).alias("width"))
    cells = cells.select("page", "row", "width", "column", F.array_join(F.transform("w", lambda w: w["text"]), " ").alias("cell"))
    lines = cells.groupBy("page", "row").agg(F.map_from_entries(F.collect_list(F.struct("column", "cell"))).alias("m"), F.max("width").alias("width"))
    line = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.try_element_at("m", i), F.lit("")))
    return lines.select("page", "row", line.alias("line")).groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]).alias("grid"))


def _cells(grid: Column) -> Column:
    """All cells with text, spaces single."""
    return F.filter(F.transform(F.flatten(grid), lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))), lambda c: c != "")


def _rows(grid: Column) -> Column:
    """Rows that have any text, cells trimmed."""
    clean = F.transform(F.coalesce(grid, F.array().cast("array<array<string>>")), lambda r: F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))))
    return F.filter(clean, lambda r: F.exists(r, lambda c: c != ""))


def _count(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def is_note_grid(grid: Column) -> Column:
    """Notes in columns: headed as such, or long cells (from 40 characters) more
    than twice as many as short ones, four at least, without a table's head or two bracketed labels."""
    rows = _rows(grid)
    head = F.coalesce(F.trim(F.array_join(F.get(rows, F.lit(0)), " ")), F.lit(""))
    cells = _cells(rows)
    long, short = _count(cells, lambda c: F.length(c) >= LONG_CELL), _count(cells, lambda c: F.length(c) < SHORT_CELL)
    labels = _count(cells, lambda c: F.replace(c, F.lit(" "), F.lit("")).rlike(LABEL))
    return head.rlike(NOTE) | ((long >= 4) & (long > short * 2) & ~head.rlike(HEADER) & (labels < 2))


def is_reference_grid(grid: Column) -> Column:
    """A list of references: two of its marks (a heading or others, links, three years, three numbers in brackets, three authors)."""
    text = F.array_join(_cells(_rows(grid)), " ")
    marks = [text.rlike(p) for p in REFERENCES] + [F.regexp_count(text, F.lit(p)) >= 3 for p in REPEATED]
    return sum((m.cast("int") for m in marks), F.lit(0)) >= 2


def is_table(grid: Column) -> Column:
    """Two rows with text at least, no notes, and the head of a table, two rows
    that begin with a bracket, or two rows with two cells."""
    rows = _rows(grid)
    head = F.coalesce(F.array_join(F.get(rows, F.lit(0)), " "), F.lit(""))
    labels = _count(rows, lambda r: F.coalesce(F.get(r, F.lit(0)).startswith("["), F.lit(False)))
    filled = _count(rows, lambda r: _count(r, lambda c: c != "") >= 2)
    return (F.size(rows) >= 2) & ~is_note_grid(grid) & (head.rlike(HEADER) | (labels >= 2) | (filled >= 2))


def is_reflow(text: Column) -> Column:
    """Text that is really the cells of a table: none, table words with one sentence at most, or no sentence in fewer than 400 characters."""
    text = F.trim(F.coalesce(text, F.lit("")))
    sentences = F.regexp_count(text, F.lit("[。！？]"))
    return (text == "") | (text.rlike(TABLE_WORDS) & (sentences <= 1)) | ((sentences == 0) & (F.length(text) < 400))
