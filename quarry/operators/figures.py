"""Which figures an answer shows.

figures: ``query_id``, ``figure``, ``place`` (its order), ``page_code``,
``pdf_page`` and ``source_index`` (the rank of its hit, or null). hits:
``query_id``, ``rank``, ``page_code``, ``pdf_page``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.citations import cited_sources
from quarry.functions.text import page_code

#: What reads as a page code in an answer, and how many figures are shown.
PAGE_CODE = r"(?i)\b([A-Z]+-[A-Z0-9]+(?:\s+\d+\s+OF\s+\d+)?)\b"
SHOWN = 2
#: Why a figure is shown: an answer cites it, or its page alone, or (no figure is cited) a cited hit is of
#: its page, it is the question's own page, it is the first; or it is the own page beside others.
TIERS = ("cited", "page", "hit", "seed", "first", "beside")


def cited_pages(answer: Column) -> Column:
    """Page codes that an answer names, distinct."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(PAGE_CODE), F.lit(1)), page_code))


def _keys(index: Column) -> Column:
    """By what a figure and a hit meet: the hit's rank, the page's code, the page's number."""
    code = F.nullif(page_code("page_code"), F.lit(""))
    parts = [F.struct(F.lit(kind).alias("kind"), value.cast("string").alias("value")) for kind, value in (("i", index), ("c", code), ("p", F.col("pdf_page")))]
    return F.explode(F.filter(F.array(*parts), lambda k: k["value"].isNotNull()))


def _meetings(figures: DataFrame, hits: DataFrame) -> DataFrame:
    """``query_id``, ``figure``, ``kind``, ``rank`` and ``code`` of hits that a figure meets."""
    mine = figures.select("query_id", "figure", _keys(F.col("source_index")).alias("k"))
    theirs = hits.select("query_id", "rank", page_code("page_code").alias("code"), _keys(F.col("rank")).alias("k"))
    return mine.join(theirs, ["query_id", "k"]).select("query_id", "figure", "k.kind", "rank", "code")


def with_source_index(figures: DataFrame, hits: DataFrame) -> DataFrame:
    """Figures without a ``source_index`` get the last hit of their page's code, else of its number."""
    met = _meetings(figures.filter("source_index is null"), hits).filter("kind <> 'i'")
    last = met.groupBy("query_id", "figure").agg(F.coalesce(F.max(F.when(F.col("kind") == "c", F.col("rank"))), F.max("rank")).alias("__rank"))
    out = figures.join(last, ["query_id", "figure"], "left")
    return out.withColumn("source_index", F.coalesce("source_index", F.col("__rank").cast(figures.schema["source_index"].dataType))).drop("__rank")


def with_new_index(figures: DataFrame, kept: DataFrame) -> DataFrame:
    """After citations were numbered anew (``kept``: ``query_id``, ``rank``,
    ``new_rank``), figures follow their hits; a figure whose hit is gone has none."""
    new = kept.select("query_id", F.col("rank").cast(figures.schema["source_index"].dataType).alias("source_index"), "new_rank")
    out = figures.join(new, ["query_id", "source_index"], "left").withColumn("source_index", F.col("new_rank").cast(figures.schema["source_index"].dataType))
    return out.select(*figures.columns)


def shown_figures(figures: DataFrame, hits: DataFrame, answers: DataFrame, most: int = SHOWN) -> DataFrame:
    """answers: ``query_id``, ``answer``, ``seed_code``. The figures to show with
    an answer: ``query_id``, ``figure``, ``tier`` and ``position``.

    First those that it cites: by their ``source_index``, by a page that is
    also some hit's, or by the page of their own hit. Then those whose page it names
    though no hit is of it. Where there are none, one figure alone: that which
    meets the first cited hit, else that of the seed page, else the first. The
    seed page's figure is added while there is room and no other figure of that
    page. Figures of questions without an answer are not shown; of repeated
    figures the first counts, and pages without a number or code meet nothing.

    A tier is a number, so a question's figures are ranked once and cut to ``most`` before anything is collected."""
    figures = figures.groupBy("query_id", "figure").agg(F.min_by(F.struct("place", "page_code", "pdf_page", "source_index"), F.struct("place", "page_code", "pdf_page", "source_index")).alias("f")).select("query_id", "figure", "f.*")
    said = answers.groupBy("query_id").agg(F.min(F.struct(F.coalesce("answer", F.lit("")).alias("answer"), page_code("seed_code").alias("seed"))).alias("a"))
    said = said.select("query_id", cited_sources(F.col("a.answer")).alias("cited"), cited_pages(F.col("a.answer")).alias("named"), F.nullif(F.col("a.seed"), F.lit("")).alias("seed"))
    met = _meetings(figures, hits).join(said, "query_id")
    cited = F.array_contains("cited", F.col("rank").cast("int"))
    met = met.groupBy("query_id", "figure").agg(
        F.max(F.col("kind") == "c").alias("of_hit"),
        F.max((F.col("kind") == "i") & (F.col("code") != "") & F.array_contains("named", F.col("code"))).alias("hit_named"),
        F.min(F.when(cited, F.col("rank"))).alias("hit"),
    )
    rows = figures.join(said, "query_id").join(met, ["query_id", "figure"], "left").withColumn("code", page_code("page_code"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    named = (F.col("code") != "") & F.array_contains("named", F.col("code"))
    tier = F.when(yes(F.array_contains("cited", F.col("source_index").cast("int"))), 0).when(named & yes(F.col("of_hit")), 0).when(named, 1).when(yes(F.col("hit_named")), 0)
    rows = rows.withColumn("own", yes(F.col("code") == F.col("seed"))).withColumn("tier", tier.when(F.col("hit").isNotNull(), 2).when(F.col("own"), 3).otherwise(4))
    seeds = rows.filter("own").groupBy("query_id").agg(F.min(F.struct("place", "figure")).alias("s")).select("query_id", F.col("s.figure").alias("seed_figure"))
    order = Window.partitionBy("query_id").orderBy("tier", F.when(F.col("tier") == 2, F.col("hit")), "place", "figure")
    # Tiers come in order, so a figure that isn't cited stands first only where none is.
    rows = rows.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).filter("tier <= 1 or n = 1")
    kept = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "tier", "figure", "own"))).alias("kept"))
    kept = kept.join(seeds, "query_id", "left")
    room = F.col("seed_figure").isNotNull() & (F.size("kept") < most) & ~F.exists("kept", lambda k: k["own"])
    own = F.array(F.struct((F.size("kept") + 1).alias("n"), F.lit(TIERS.index("beside")).alias("tier"), F.col("seed_figure").alias("figure"), F.lit(True).alias("own")))
    shown = F.when(room, F.concat("kept", own)).otherwise(F.col("kept"))
    out = kept.select("query_id", F.explode(shown).alias("k"))
    return out.select("query_id", "k.figure", F.get(F.array(*map(F.lit, TIERS)), F.col("k.tier")).alias("tier"), F.col("k.n").alias("position"))
