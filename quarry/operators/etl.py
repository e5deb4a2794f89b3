"""From pages and lines to chunks: detection, carrying forward, packing, naming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TARGET, OVERLAP = 1100, 160
#: Page numbers that a task goes through in order when books are cut into chapters.
STRETCH = 1000
TOC_LINE = r"(?m)^(.+?)\.{3,}\s*(?:MS-)?(\d+)\s*$"
LOCATOR = r"(?i)(ncbi\.nlm\.nih\.gov|doi\.org|pubmed)"
NUMBERED = r"(?m)^\s*\d{1,3}\.\s+[A-Z]"


def is_toc(text: Column) -> Column:
    """Whether a page has five lines with dotted leaders or more."""
    return F.regexp_count(text, F.lit(TOC_LINE)) >= 5


def toc_entries(pages: DataFrame) -> DataFrame:
    """``page_id``, ``at``, ``title``, ``start`` of contents pages."""
    titles, starts = (F.regexp_extract_all("text", F.lit(TOC_LINE), F.lit(k)) for k in (1, 2))
    rows = pages.filter(is_toc(F.col("text"))).select("page_id", F.posexplode(F.arrays_zip(titles.alias("title"), starts.alias("start"))).alias("at", "x"))
    return rows.select("page_id", "at", F.trim("x.title").alias("title"), F.col("x.start").cast("int").alias("start"))


def is_reference_page(text: Column) -> Column:
    """A heading of references, three lines with a locator, or two such lines and two numbered entries."""
    lines = F.size(F.filter(F.split(text, "\n"), lambda x: x.rlike(LOCATOR)))
    return text.rlike(r"(?mi)^\s*references\s*$") | (lines >= 3) | ((F.regexp_count(text, F.lit(NUMBERED)) >= 2) & (lines >= 2))


def running_header(pages: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """The first non-blank line that most pages of an article share, if on
    enough of them (``least``, and that ``share`` of all): ``article_id``,
    ``header``, ``n``."""
    header = F.trim(F.regexp_extract("text", r"^[ \n]*([^\n]*)", 1))
    rows = pages.select("article_id", "pos", F.nullif(header, F.lit("")).alias("header"))
    total = rows.groupBy("article_id").agg(F.count("*").alias("pages"))
    counts = rows.filter("header is not null").groupBy("article_id", "header").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    best = counts.groupBy("article_id").agg(F.max(F.struct("n", (-F.col("first")).alias("back"), "header")).alias("m"))
    best = best.select("article_id", "m.header", "m.n").join(total, "article_id")
    return best.filter(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("pages") * share))).select("article_id", "header", "n")


def carry_forward(rows: DataFrame, group: str, order: list[str], value: Column, name: str, default: str | None = None) -> DataFrame:
    """The last value that is not null up to each row."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(default)))


def islands(rows: DataFrame, group: str, order: list[str], starts: Column, name: str) -> DataFrame:
    """A running number that grows at each row where ``starts`` holds."""
    w = Window.partitionBy(group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.sum(starts.cast("int")).over(w))


def segments(pages: DataFrame, book: str = "book", page: str = "page", kind: str = "kind", stretch: int = STRETCH) -> DataFrame:
    """The chapter of each page of a book whose chapters are body pages
    and then their references: a chapter starts at the first body page and at each body
    page that follows references. ``kind`` is ``body``, ``refs`` or ``toc``;
    pages of contents neither have a chapter nor come between others, and references before any
    body are in chapter 0. ``page`` is a whole number, each once in a book.

    What a run of pages does to the state (in a body, in references) depends on the state
    before it only at its first page of either kind. So stretches of
    ``stretch`` page numbers are gone through each for itself, and a book's stretches, one row
    each, are then put in order: a long book isn't one task."""
    rows = pages.withColumn("__part", F.floor(F.col(page) / stretch))
    real = F.when(F.col(kind) != "toc", F.col(kind))
    inside = Window.partitionBy(book, "__part").orderBy(page)
    rows = rows.withColumn("__last", F.last(real, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    opens, asks = (F.col(kind) == "body") & (F.col("__last") == "refs"), (F.col(kind) == "body") & F.col("__last").isNull()
    rows = rows.withColumn("__opens", F.coalesce(opens, F.lit(False)).cast("int")).withColumn("__asks", asks.cast("int"))
    parts = rows.groupBy(book, "__part").agg(F.max_by(real, F.when(real.isNotNull(), F.col(page))).alias("__end"), F.sum("__opens").alias("__n"), F.max("__asks").alias("__asked"))
    before = Window.partitionBy(book).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("__more", F.when(F.coalesce(F.last("__end", ignorenulls=True).over(before), F.lit("refs")) == "refs", F.col("__asked")).otherwise(0))
    parts = parts.withColumn("__base", F.coalesce(F.sum(F.col("__n") + F.col("__more")).over(before), F.lit(0)))
    # A first page that opens its stretch counts from there on.
    inner = F.sum(F.col("__opens") + F.col("__asks") * F.col("__more")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.join(parts.select(book, "__part", "__base", "__more"), [book, "__part"]).withColumn("__inner", inner)
    chapter = F.when(F.col(kind) != "toc", F.col("__base") + F.col("__inner")).cast("long")
    return rows.withColumn("chapter", chapter).drop("__part", "__last", "__opens", "__asks", "__base", "__more", "__inner")


def is_heading(line: Column) -> Column:
    return F.length(line).between(4, 80) & ~line.endswith(".") & F.substring(line, 1, 1).rlike(r"\p{Lu}")


def pack(pieces: Column, target: int = TARGET, separator: str = "\n\n") -> Column:
    """Pieces of text packed in order: a chunk closes when the next piece would take it beyond ``target``."""
    empty = F.array().cast("array<string>")
    state = F.struct(empty.alias("done"), F.lit("").alias("open"), F.lit(0).alias("size"), F.lit(False).alias("any"))

    def step(a: Column, p: Column) -> Column:
        full = a["any"] & (a["size"] + F.length(p) > target)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"),
            F.when(full | ~a["any"], p).otherwise(F.concat(a["open"], F.lit(separator), p)).alias("open"),
            F.when(full, F.length(p)).otherwise(a["size"] + F.length(p)).alias("size"),
            F.lit(True).alias("any"),
        )

    return F.aggregate(pieces, state, step, lambda a: F.when(a["any"], F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]))


def overlap_tail(text: Column, most: int = OVERLAP) -> Column:
    """The last whole sentences of a text, the last one always, others while they fit."""
    parts = F.filter(F.split(F.trim(F.replace(text, F.lit("\n"), F.lit(" "))), r"(?<=[.。!?！？])\s+"), lambda s: s != "")
    state = F.struct(F.lit("").alias("tail"), F.lit(0).alias("size"), F.lit(False).alias("any"), F.lit(False).alias("shut"))

    def step(a: Column, s: Column) -> Column:
        shut = a["shut"] | (a["any"] & (a["size"] + F.length(s) > most))
        return F.struct(
            F.when(shut, a["tail"]).when(a["any"], F.concat(s, F.lit(" "), a["tail"])).otherwise(s).alias("tail"),
            F.when(shut, a["size"]).otherwise(a["size"] + F.length(s)).alias("size"),
            F.lit(True).alias("any"),
            shut.alias("shut"),
        )

    return F.aggregate(F.reverse(parts), state, step, lambda a: F.trim(a["tail"]))


def chunk_sections(rows: DataFrame, target: int = TARGET, overlap: int = OVERLAP) -> DataFrame:
    """rows: ``doc_id``, ``pos``, ``piece``. Sections begin at headings and are
    packed on their own; a chunk begins with the last sentences of the one
    before it in its section. Returns ``doc_id``, ``section_no``, ``section``,
    ``at``, ``chunk``."""
    rows = rows.filter(F.trim("piece") != "")
    heading = is_heading(F.col("piece"))
    rows = islands(rows, "doc_id", ["pos"], heading, "section_no")
    rows = carry_forward(rows, "doc_id", ["pos"], F.when(heading, F.col("piece")), "section", "Discussion")
    packed = rows.groupBy("doc_id", "section_no", "section").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("pieces"))
    packed = packed.withColumn("chunks", pack(F.transform("pieces", lambda p: p["piece"]), target))
    body = F.transform("chunks", lambda c, i: F.when((i > 0) & F.lit(overlap > 0), F.concat(overlap_tail(F.get("chunks", i - 1), overlap), F.lit("\n\n"), c)).otherwise(c))
    return packed.select("doc_id", "section_no", "section", F.posexplode(body).alias("at", "chunk"))


def unique_ids(rows: DataFrame, base: str, order: list[str], suffix: str = "-x") -> DataFrame:
    """The first row keeps its id, later ones get a number after it."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(*order)) - 1
    return rows.withColumn("n", n).withColumn("unique_id", F.when(F.col("n") == 0, F.col(base).cast("string")).otherwise(F.concat(F.col(base).cast("string"), F.lit(suffix), F.col("n").cast("string")))).drop("n")


def clusters(rows: DataFrame, group: str, value: str, gap: float) -> DataFrame:
    """Sorted values cut where they are more than ``gap`` apart: each cluster's mean and size."""
    w = Window.partitionBy(group).orderBy(value)
    rows = rows.withColumn("new", (F.coalesce(F.col(value) - F.lag(value).over(w), F.lit(0.0)) > gap).cast("int"))
    rows = rows.withColumn("cluster", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(group, "cluster").agg(F.avg(value).alias("centre"), F.count("*").alias("n"))


def knowledge_documents(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pages and chunks (``source_id``, ``pos``, ``text``, ``page_type``) that have text, first of each id, in one order."""
    both = pages.withColumn("part", F.lit(0)).unionByName(chunks.withColumn("part", F.lit(1)), allowMissingColumns=True)
    both = both.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    first = Window.partitionBy("source_id").orderBy("part", "pos")
    both = both.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    return both


def knowledge_stats(docs: DataFrame) -> DataFrame:
    """Documents, their text and their distinct sections by page type."""
    return docs.groupBy("page_type").agg(F.count("*").alias("n"), F.count_if(F.col("text").isNotNull()).alias("with_text"), F.array_join(F.array_sort(F.collect_set("section")), ",").alias("sections"))


def section_bounds(pages: DataFrame, signals: dict[str, str]) -> DataFrame:
    """The first and last page with each signal (a pattern), in one scan."""
    at = [F.when(F.col("text").rlike(p), F.col("page")) for p in signals.values()]
    found = pages.agg(*(f(c).alias(f"{n}{k}") for k, c in enumerate(at) for n, f in (("first", F.min), ("last", F.max))))
    rows = [F.struct(F.lit(name).alias("signal"), F.col(f"first{k}").alias("first"), F.col(f"last{k}").alias("last")) for k, name in enumerate(signals)]
    return found.select(F.explode(F.array(*rows)).alias("r")).select("r.first", "r.last", "r.signal")


def table_markdown(rows: Column) -> Column:
    """An array of rows of cells as a Markdown table with its header line."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, lambda c: F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(F.get(rows, F.lit(0)), lambda c: F.lit("---")), " | "), F.lit(" |"))
    return F.array_join(F.concat(F.array(line(F.get(rows, F.lit(0))), rule), F.transform(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), line)), "\n")


def merge_continuations(rows: DataFrame, group: str, order: list[str], first: str, other: str) -> DataFrame:
    """Table rows whose first cell is blank continue the row before them."""
    rows = islands(rows, group, order, F.trim(F.coalesce(first, F.lit(""))) != "", "row_no")
    place = F.struct(*order, F.col(other).alias("cell"))
    out = rows.groupBy(group, "row_no").agg(F.max(F.when(F.trim(F.coalesce(first, F.lit(""))) != "", F.col(first))).alias(first), F.sort_array(F.collect_list(place)).alias("cells"))
    return out.select(group, "row_no", first, F.array_join(F.filter(F.transform("cells", lambda c: F.trim(F.coalesce(c["cell"], F.lit("")))), lambda c: c != ""), " ").alias(other))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Chunks of each ``article_id`` and how many are tables (by ``content_type``)."""
    return chunks.groupBy("article_id").agg(F.count("*").alias("chunks"), F.count_if(F.coalesce("content_type", F.lit("text")) == "table").alias("tables"))
