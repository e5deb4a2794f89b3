"""Names of chapters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.text import slug


def squeezed(title: Column) -> Column:
    """A title in lower case with single spaces; null where it is blank."""
    key = F.trim(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), r"\s+", " "))
    return F.nullif(key, F.lit(""))


def chapter_labels(chapters: DataFrame, contents: DataFrame, subjects: Sequence[tuple[str, str, str]], default: tuple[str, str] = ("general", "General")) -> DataFrame:
    """chapters: ``doc_id``, ``chapter``, ``lines`` (where its title may stand, in
    order) and ``heading``; contents: ``doc_id``, ``at``, ``title`` of its table of
    contents; subjects: pattern, id and title, in order of preference.

    The first line that equals a title of the contents, letter case and spaces
    apart, names the chapter, else its heading does. A subject whose pattern is
    in that name gives id and title; else the id is the name's slug (the
    default's where it has no letter). Chapters without either get ``default``.
    Adds ``article_id``, ``title`` and ``told_by``: contents, heading or default.

    Lines meet titles on a key that is never null; chapters without lines take no part in that join."""
    lines = chapters.select("doc_id", "chapter", F.posexplode("lines").alias("at", "line")).select("doc_id", "chapter", "at", squeezed(F.col("line")).alias("key")).filter("key is not null")
    known = contents.select("doc_id", squeezed(F.col("title")).alias("key"), "at", "title").filter("key is not null").groupBy("doc_id", "key").agg(F.min_by("title", F.struct("at", "title")).alias("known"))
    told = lines.join(known, ["doc_id", "key"]).groupBy("doc_id", "chapter").agg(F.min_by("known", "at").alias("known"))
    rows = chapters.join(told, ["doc_id", "chapter"], "left")
    heading = F.nullif(F.trim(F.coalesce("heading", F.lit(""))), F.lit(""))
    rows = rows.withColumn("__name", F.coalesce("known", heading))
    # One value for both, so that a subject's patterns are tried once.
    subject = F.coalesce(*[F.when(F.col("__name").rlike(p), F.struct(F.lit(i).alias("id"), F.lit(t).alias("title"))) for p, i, t in subjects], F.lit(None).cast("struct<id:string,title:string>"))
    rows = rows.withColumn("__subject", subject)
    own = F.when(F.col("__name").isNotNull(), F.coalesce(F.nullif(slug("__name"), F.lit("")), F.lit(default[0])))
    return rows.select(
        "doc_id",
        "chapter",
        F.coalesce("__subject.id", own, F.lit(default[0])).alias("article_id"),
        F.coalesce("__subject.title", "__name", F.lit(default[1])).alias("title"),
        F.when(F.col("known").isNotNull(), "contents").when(heading.isNotNull(), "heading").otherwise("default").alias("told_by"),
    )
