"""Mixing sources to target weights by capped water-filling.

All sources together are to give ``total`` words. Each gets a share in
proportion to its weight, but never more than ``max_epochs`` times its size;
what that cuts off is shared among the others in proportion to their weights,
again and again until no target is above its cap. The fixed point is the level
at which ``sum(least(cap, weight * level)) = total``, found with running sums
over the sources in the order in which they reach their caps.

Documents are then repeated: each one ``floor(target / size)`` whole times, and
the fraction that is left by a seeded order of the source's documents, from
its start until the words reach the target. That start is found in two steps,
so that no source is ever in one task: words summed by slice of the order
(``SLICES`` at most), running sums over those, and a running sum of documents
in the one slice where the target falls. The document there is taken if that
brings the words nearer to the target.

Defined results: a null text has size 0 and is taken 0 words; a null source is
a source, the last; a source of size 0 has target 0; repeated rows are drawn
one by one; an empty table gives an empty result. ``mix`` keeps a document's
columns in a struct, so they may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.shared import stage

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = "mix-1"
#: Hexadecimal digits of the seeded order that make a slice: 65,536 slices of a source.
SLICE_DIGITS = 4

WORDS = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sizes: ``source`` and ``source_size``, a row per source. Adds ``target``.

    Spark sorts strings by their bytes in UTF-8, which is code point order.
    The windows run over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(by_name) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")).cast("long"))
    rows = rows.withColumn("cap", F.col("source_size") * max_epochs)
    everything = Window.partitionBy()
    order = Window.orderBy((F.col("cap").cast("double") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = (
        rows.withColumn("total", F.sum("source_size").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("free", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    )
    # A source is below its cap if, with all before it at theirs, an equal level for the rest stays below it.
    left, free = (F.col("total") - F.col("capped")).cast("double"), F.col("free").cast("double")
    rows = rows.withColumn("level", F.when(left / free <= F.col("cap").cast("double") / F.col("weight"), left / free))
    level = F.first("level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = rows.withColumn("level", level)
    cap = F.col("cap").cast("double")
    return rows.select("source", "source_size", F.least(cap, F.coalesce(F.col("weight") * F.col("level"), cap)).alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    weights: tuple[int, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """One row per document: its columns as the struct ``row``, ``size``,
    ``source_size``, ``target`` and ``repeats``, how often the mix has it."""
    row = F.struct("*") if keep is None else F.struct(*(F.col(f"`{c}`") for c in keep))
    draw = F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.lit(seed)))
    rows = docs.select(
        row.alias("row"),
        F.col(source_col).alias("source"),
        F.col(text_col).alias("text"),
        F.col(id_col).alias("id"),
        draw.alias("draw"),
    ).withColumn("slice", F.substring("draw", 1, SLICE_DIGITS))
    by_slice = stage(rows.groupBy("source", "slice").agg(F.sum(size_of(F.col("text"))).alias("words")), "mix-slices")
    shares = targets(by_slice.groupBy("source").agg(F.sum("words").alias("source_size")), weights, max_epochs)
    # What is wanted beyond whole repetitions, in words.
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    shares = shares.withColumn("whole", whole).withColumn("wanted", F.col("target") - F.col("whole") * F.col("source_size"))
    # The slice where the wanted words end; those before it are taken, those after it aren't.
    same = lambda a, b: F.col(f"{a}.source").eqNullSafe(F.col(f"{b}.source"))
    start = Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = by_slice.withColumn("start", F.coalesce(F.sum("words").over(start), F.lit(0)))
    slices = slices.alias("a").join(shares.alias("b"), same("a", "b")).select("b.*", "a.slice", "a.start", "a.words")
    ends = (F.col("start") < F.col("wanted")) & (F.col("start") + F.col("words") >= F.col("wanted"))
    shares = stage(
        slices.groupBy("source", "source_size", "target", "whole", "wanted").agg(
            F.max(F.when(ends, F.col("slice"))).alias("cut"), F.max(F.when(ends, F.col("start"))).alias("start")
        ),
        "mix-shares",
    )  # a row per source: its written size decides whether Spark broadcasts it
    rows = rows.alias("a").join(shares.alias("b"), same("a", "b")).select("a.*", *(f"b.{c}" for c in ("source_size", "target", "whole", "wanted", "cut", "start")))
    at_cut = F.col("slice").eqNullSafe(F.col("cut"))
    sure = rows.filter(~at_cut).withColumn("size", size_of(F.col("text")))
    sure = sure.withColumn("part", F.coalesce(F.col("slice") < F.col("cut"), F.lit(False)).cast("long"))
    within = Window.partitionBy("source").orderBy("draw", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.filter(at_cut).withColumn("size", size_of(F.col("text")))
    edge = edge.withColumn("before", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    edge = edge.withColumn("part", (F.col("before") + F.col("size") / F.lit(2.0) <= F.col("wanted")).cast("long")).drop("before")
    return sure.unionByName(edge).select("row", "size", "source_size", "target", (F.col("whole") + F.col("part")).alias("repeats"))


def mixing_digest(docs: DataFrame) -> DataFrame:
    return mix(docs, keep=("doc_id",)).select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document's columns, as often as it is repeated."""
    return mix(docs).filter("repeats > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias("k")).select("row.*")


#: DuckDB SQL for ``mixing_digest``.
ORACLE_SQL = rf"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), 'null') || '|{SEED}') AS draw
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, [{', '.join(map(str, WEIGHTS))}][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(WEIGHTS)}] AS weight, source_size * {MAX_EPOCHS} AS cap FROM s),
c AS (
  SELECT *, sum(source_size) OVER () AS total,
    coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
    sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS free
  FROM w),
l AS (
  SELECT arg_min(CAST(total - capped AS DOUBLE) / CAST(free AS DOUBLE), capped) AS level
  FROM c WHERE CAST(total - capped AS DOUBLE) / CAST(free AS DOUBLE) <= CAST(cap AS DOUBLE) / weight),
t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), coalesce(weight * level, CAST(cap AS DOUBLE))) AS target
  FROM w CROSS JOIN l),
r AS (
  SELECT d.*, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS whole,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (whole + CASE WHEN before + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
