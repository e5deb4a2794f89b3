"""Which subject a question is about, what evidence fits it, and what is shown with an answer."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import overlap, token_set

DIGITS = 6


@dataclass(frozen=True)
class ScopeRule:
    """A subject, the pattern that names it, and its weight against others."""

    key: str
    pattern: str
    priority: int


def detect_scope(text: Column, rules: Sequence[ScopeRule], default: str = "all") -> Column:
    """The subject with the highest priority whose pattern is found; the first of equals."""
    found = [F.when(text.rlike(r.pattern), F.struct(F.lit(r.priority).alias("p"), F.lit(-k).alias("back"), F.lit(r.key).alias("key"))) for k, r in enumerate(rules)]
    return F.coalesce(F.array_max(F.array_compact(F.array(*found)))["key"], F.lit(default))


def parse_source_id(source_id: Column) -> Column:
    """Article and module of ``disc-<article>-p#-c#``, ``ref-<article>-#`` and ``page-<MODULE>-...``; nulls otherwise."""
    empty = lambda c: F.nullif(c, F.lit(""))
    article = F.coalesce(empty(F.regexp_extract(source_id, r"^disc-(.+)-p\d+-(?:[a-z]*)?c?\d+$", 1)), empty(F.regexp_extract(source_id, r"^ref-(.+)-\d+$", 1)))
    module = empty(F.regexp_extract(source_id, r"^page-([A-Za-z]+)-", 1))
    return F.struct(article.alias("article"), module.alias("module"))


def scope_verdict(source_ids: Column, articles: Column, modules: Column) -> Column:
    """Whether any source that can be told lies in the scope; null if none can be told."""
    parsed = F.transform(source_ids, parse_source_id)
    verdicts = F.transform(parsed, lambda p: F.when(p["article"].isNotNull(), F.array_contains(articles, p["article"])).when(p["module"].isNotNull(), F.array_contains(modules, p["module"])))
    known = F.filter(verdicts, lambda v: v.isNotNull())
    return F.when(F.size(known) > 0, F.exists(known, lambda v: v))


def in_scope(rows: DataFrame, source_ids: Column, articles: Column, modules: Column) -> DataFrame:
    """Rows that aren't known to be out of scope."""
    return rows.filter(F.coalesce(scope_verdict(source_ids, articles, modules), F.lit(True)))


def lexical_gate(hits: DataFrame, least: int = 2) -> DataFrame:
    """hits: ``query_id``, ``rank``, ``query``, ``text``. Those that share a word with their query, and the first ``least`` in any case."""
    return hits.withColumn("overlap", F.round(overlap(token_set("query"), token_set("text")), DIGITS)).filter((F.col("overlap") > 0) | (F.col("rank") <= least))


def unless_empty(rows: DataFrame, keep: Column, by: str = "query_id") -> DataFrame:
    """Rows that ``keep`` holds for; all rows of a group where it holds for none."""
    some = F.max(F.coalesce(keep, F.lit(False))).over(Window.partitionBy(by))
    return rows.withColumn("__keep", F.coalesce(keep, F.lit(False))).withColumn("__some", some).filter(F.col("__keep") | ~F.col("__some")).drop("__keep", "__some")


def inject(hits: DataFrame, extra: DataFrame, most: int, wanted: Column) -> DataFrame:
    """Add up to ``most`` of ``extra`` (by rank) to queries of whose hits ``wanted`` holds for none."""
    has = hits.groupBy("query_id").agg(F.max(F.coalesce(wanted, F.lit(False))).alias("has"))
    lost = has.filter(~F.col("has")).select("query_id")
    new = extra.join(hits.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti").join(lost, "query_id", "left_semi").filter(wanted)
    order = Window.partitionBy("query_id").orderBy("rank", "doc_id")
    new = new.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n")
    return hits.unionByName(new)


def ordered_union(lists: Sequence[DataFrame], most: int) -> DataFrame:
    """Several lists of ``query_id``, ``item``, ``place``, one after another, each item once, the first ``most``."""
    rows = None
    for k, x in enumerate(lists):
        part = x.select("query_id", "item", "place", F.lit(k).alias("list"))
        rows = part if rows is None else rows.unionByName(part)
    first = Window.partitionBy("query_id", "item").orderBy("list", "place")
    rows = rows.withColumn("n", F.row_number().over(first)).filter("n = 1")
    out = rows.withColumn("position", F.row_number().over(Window.partitionBy("query_id").orderBy("list", "place", "item")))
    return out.filter(F.col("position") <= most).select("query_id", "item", "position")


def selected_pages(candidates: DataFrame, requested: DataFrame, most: int, kinds: Sequence[str], fallback: int = 2) -> DataFrame:
    """The pages to look at for each question: those asked for
    (``query_id``, ``item``, ``place``) that are among its candidates (the same and ``kind``), the
    first ``most`` by place; for a question with none of them, candidates of the first of
    ``kinds`` that it has, ``fallback`` at most. Returns ``query_id``, ``item``, ``kind``, ``tier`` (0: asked for) and ``position``.

    A tier is a number, so the tier that counts is one minimum for each question, and only its first rows are ranked."""
    one = candidates.groupBy("query_id", "item").agg(F.min_by("kind", "place").alias("kind"), F.min("place").alias("at"))
    asked = requested.groupBy("query_id", "item").agg(F.min("place").alias("asked"))
    tier = F.when(F.col("asked").isNotNull(), 0)
    for k, kind in enumerate(kinds):
        tier = tier.when(F.col("kind") == kind, k + 1)
    rows = one.join(asked, ["query_id", "item"], "left").withColumn("tier", tier).filter("tier is not null")
    first = rows.groupBy("query_id").agg(F.min("tier").alias("tier"))
    order = Window.partitionBy("query_id").orderBy(F.coalesce("asked", "at"), "item")
    rows = rows.join(first, ["query_id", "tier"]).withColumn("position", F.row_number().over(order)).filter(F.col("position") <= most)
    return rows.filter((F.col("tier") == 0) | (F.col("position") <= fallback)).select("query_id", "item", "kind", "tier", "position")


def first_mentions(figures: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """figures: ``doc_id``, ``figure``, ``label``; paragraphs: ``doc_id``, ``at``,
    ``text``. The first paragraph of its document that names a figure's label."""
    rows = figures.join(paragraphs, "doc_id").filter(F.col("text").contains(F.col("label")))
    return rows.groupBy("doc_id", "figure").agg(F.min("at").alias("anchor"))


def box_union(rows: DataFrame, by: str) -> DataFrame:
    """The smallest box around the boxes (``x0``, ``y0``, ``x1``, ``y1``) of each group, and its area."""
    out = rows.groupBy(by).agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return out.withColumn("area", (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))


def best_overlap(links: DataFrame, blocks: DataFrame, page: str = "page", cell: float = 50.0) -> DataFrame:
    """For each link box, the block on its page that covers most of it (more
    than nothing; of equal ones that with the smallest id).

    Boxes meet in the cells of grids, each twice as coarse as the one before. A
    box belongs to the first grid whose cells are at least as long as its
    longer side, so it reaches into few cells; two boxes meet in the grid of the
    larger one. Boxes that are empty or not finite overlap with nothing."""
    sides = ("x0", "y0", "x1", "y1")

    def boxes(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.select(F.col(page).alias("page"), F.col(name), *(F.col(c).cast("double").alias(c) for c in sides))
        rows = rows.filter(F.col("page").isNotNull() & (F.col("x1") > F.col("x0")) & (F.col("y1") > F.col("y0")))
        rows = rows.filter(" and ".join(f"abs({c}) < double('infinity')" for c in sides))  # nor NaN, which is larger
        longer = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
        return rows.select("page", name, F.struct(*sides).alias(name[0]), F.greatest(F.lit(0), F.ceil(F.log2(longer / cell))).cast("int").alias("own"))

    links, blocks = boxes(links, "link_id"), boxes(blocks, "block_id")
    top = links.select("own").union(blocks.select("own")).agg(F.max("own")).first()[0] or 0

    def cells(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.withColumn("grid", F.explode(F.sequence("own", F.lit(top))))
        width = F.lit(cell) * F.pow(F.lit(2.0), F.col("grid"))
        for axis in "xy":
            reach = F.sequence(F.floor(F.col(f"{name}.{axis}0") / width), F.floor(F.col(f"{name}.{axis}1") / width))
            rows = rows.withColumn("c" + axis, F.explode(reach))
        return rows.withColumnRenamed("own", f"{name}_own")

    rows = cells(links, "l").join(cells(blocks, "b"), ["page", "grid", "cx", "cy"]).filter("grid = greatest(l_own, b_own)")
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(F.col(f"l.{hi}"), F.col(f"b.{hi}")) - F.greatest(F.col(f"l.{lo}"), F.col(f"b.{lo}")))
    rows = rows.select("link_id", "block_id", (side("x0", "x1") * side("y0", "y1")).alias("area")).filter("area > 0")
    best = F.max(F.struct("area", (-F.col("block_id")).alias("back"), "block_id"))
    return rows.groupBy("link_id").agg(best.alias("m")).select("link_id", "m.block_id", "m.area")


def box_quality(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """invalid, full_page, narrow or good, for boxes within a page of size 1."""
    w, h = x1 - x0, y1 - y0
    return F.when((w <= 0) | (h <= 0) | (F.least(x0, y0) < 0) | (F.greatest(x1, y1) > 1), "invalid").when(w * h > 0.9, "full_page").when(F.least(w, h) < 0.05, "narrow").otherwise("good")


def display_title(kind: Column, title: Column, source: Column, year: Column) -> Column:
    """A line for a source: its parts that aren't null, by kind."""
    return F.when(kind == "reference", F.concat_ws(" · ", source, year, title)).otherwise(F.concat_ws(" · ", title, source))
