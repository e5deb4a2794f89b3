"""Triples: search around entities, scoring, subgraphs and bounded page navigation.

A triple has ``triple_id``, ``subject_id``, ``subject_name``, ``relation``,
``object_id``, ``object_name``, ``object_type``, ``confidence``,
``validation_status``, ``review_status``, ``evidence_kind``, ``evidence_text``
and ``evidence_source_ids``. Walks are loops over a fixed, small number of hops;
each hop is a join, and what is known about an entity is one row.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import contains_any, module_of, overlap, page_code, pieces, token_set

DIGITS = 6
#: Characters of a word's start by which texts that may contain it are found.
STEM = 4
#: Weights of evidence kinds; others have the last.
SOURCE_QUALITY = {"guideline": 0.18, "consensus": 0.16, "randomized_trial": 0.15, "cohort_study": 0.10, "discussion": 0.06, "reference_only": 0.03, "text": 0.05}
OTHER_QUALITY = 0.05
#: Words of support in a text, and of a first choice.
SUPPORT_WORDS = ("recommended", "should", "preferred", "indicated", "guideline")
CUE_WORDS = ("first-line", "一线", "r-chop", "pola-r-chp", "preferred")


def doubled(triples: DataFrame, *carry: str) -> DataFrame:
    """Each triple from both of its ends: ``entity``, ``other``, ``triple_id``."""
    keep = ["triple_id", *carry]
    a = triples.select(F.col("subject_id").alias("entity"), F.col("object_id").alias("other"), *keep)
    b = triples.filter("subject_id <> object_id").select(F.col("object_id").alias("entity"), F.col("subject_id").alias("other"), *keep)
    return a.unionByName(b)


def reach(triples: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """seeds: ``query_id``, ``entity``. The entities within ``hops`` of a
    query's seeds and how far the nearest is: ``query_id``, ``entity``, ``depth``."""
    links = doubled(triples).select("entity", "other").distinct()
    found = seeds.select("query_id", "entity").distinct().withColumn("depth", F.lit(0))
    front = found
    for depth in range(1, hops + 1):
        step = front.join(links, "entity").select("query_id", F.col("other").alias("entity")).distinct()
        front = step.join(found, ["query_id", "entity"], "left_anti").withColumn("depth", F.lit(depth))
        found = found.unionByName(front)
    return found


def triple_score(depth: Column, seeded: Column) -> Column:
    """How good a triple is by itself and ``depth`` hops away, from 0 to 1."""
    text = F.lower(F.coalesce("evidence_text", F.lit("")))
    kind = F.lower(F.coalesce("evidence_kind", F.lit("text")))
    quality = F.lit(None).cast("double")
    for k, v in SOURCE_QUALITY.items():
        quality = F.coalesce(quality, F.when(kind == k, F.lit(v)))
    n = F.coalesce(F.size("evidence_source_ids"), F.lit(0))
    support = F.least(F.lit(0.12), 0.03 * F.greatest(F.lit(0), n - 1)) + F.when(n >= 3, 0.04).otherwise(0.0)
    said = lambda c: F.when(F.coalesce((F.col(c) != "") & text.contains(F.lower(c)), F.lit(False)), 0.04).otherwise(0.0)
    match = said("subject_name") + said("relation") + said("object_name") + F.when(contains_any(text, SUPPORT_WORDS), 0.05).otherwise(0.0)
    structure = F.when(seeded, 0.10).otherwise(0.0) + F.greatest(F.lit(0.0), 0.08 - 0.04 * depth)
    review = F.when(F.col("validation_status") == "trusted", 0.08).otherwise(0.0) + F.when(F.col("review_status") == "approved", 0.05).otherwise(0.0)
    minus = 0.06 * depth + F.when(F.col("validation_status").isin("needs_review", "conflicted"), 0.10).otherwise(0.0) + F.when(F.length(text) < 40, 0.05).otherwise(0.0)
    total = F.coalesce("confidence", F.lit(0.0)) + F.coalesce(quality, F.lit(OTHER_QUALITY)) + support + match + structure + review - minus
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def relevance(query: Column, therapy: Column, therapy_words: tuple[str, ...], therapy_relations: tuple[str, ...], cues: tuple[str, ...] = CUE_WORDS) -> Column:
    """How well a triple answers a question, from 0 to 1; for a question about
    therapy, 0 unless it speaks of one."""
    blob = F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in ("subject_name", "relation", "object_name", "object_type", "evidence_text"))))
    looks = contains_any(blob, therapy_words)
    bonus = F.when(therapy & F.upper("relation").isin(*therapy_relations), 0.25).otherwise(0.0) + F.when(therapy & looks, 0.3).otherwise(0.0)
    bonus = bonus + F.when(contains_any(blob, cues), 0.15).otherwise(0.0)
    q = token_set(query)
    share = F.when(F.size(q) > 0, overlap(q, token_set(blob))).otherwise(0.0)
    return F.when(therapy & ~looks, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share + bonus)))


def retrieve(
    triples: DataFrame,
    seeds: DataFrame,
    queries: DataFrame,
    hops: int = 1,
    top_k: int = 8,
    least: float = 0.12,
    therapy_marks: tuple[str, ...] = ("therapy", "treatment", "治疗"),
    therapy_words: tuple[str, ...] = ("therapy", "treatment", "治疗"),
    therapy_relations: tuple[str, ...] = ("RECOMMENDS", "INDICATED_FOR", "PREFERRED_OVER", "APPLIES_TO"),
) -> DataFrame:
    """The best triples around the seeds of each query. Entities up to ``hops``
    away pass their triples on, so triples ``hops + 1`` away come too. A triple
    reached on several ways has its best score. Adds ``score``, ``relevance``,
    ``depth`` and ``rank``."""
    near = reach(triples, seeds, hops)
    arrivals = near.join(doubled(triples).select("entity", "triple_id"), "entity").groupBy("query_id", "triple_id").agg(F.min("depth").alias("depth"))
    heads = seeds.groupBy("query_id").agg(F.collect_set("entity").alias("seeds"))
    rows = arrivals.join(triples, "triple_id").join(queries, "query_id").join(heads, "query_id")
    seeded = F.array_contains("seeds", F.col("subject_id")) | F.array_contains("seeds", F.col("object_id"))
    therapy = contains_any(F.lower("query"), therapy_marks)
    rows = rows.withColumn("relevance", F.round(relevance(F.col("query"), therapy, therapy_words, therapy_relations), DIGITS))
    # Depth only ever lowers a score, so the nearest arrival is the best one.
    score = F.least(F.lit(1.0), triple_score(F.col("depth"), seeded) * 0.65 + F.col("relevance") * 0.55)
    rows = rows.withColumn("score", F.round(score, DIGITS)).withColumn("least", F.when(therapy, F.lit(least)).otherwise(F.lit(least * 0.5)))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("confidence"), "triple_id")
    rows = rows.filter(F.col("relevance") >= F.col("least")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)
    return rows.select("query_id", "triple_id", "score", "relevance", "depth", "rank")


def lexical_fallback(triples: DataFrame, queries: DataFrame, top_k: int = 8) -> DataFrame:
    """For queries without seeds: triples whose text has any of the question's words."""
    words = queries.select("query_id", F.explode(F.array_distinct(F.split(F.lower("query"), r"\s+"))).alias("word")).filter(F.length("word") > 1)
    text = F.lower(F.concat_ws(" ", "subject_name", "relation", "object_name", "evidence_text"))
    # A word's start is a key: every part of that length of a triple's text is looked up, then the word itself.
    parts = triples.select("triple_id", "confidence", text.alias("text")).withColumn("piece", F.explode(pieces(F.col("text"), STEM, 2)))
    rows = parts.join(words.withColumn("piece", F.substring("word", 1, STEM)), "piece").filter(F.col("text").contains(F.col("word")))
    rows = rows.select("query_id", "triple_id", "confidence").distinct().withColumn("score", F.round(F.col("confidence") * 0.8 + 0.2, DIGITS))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "triple_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def subgraph(triples: DataFrame, seeds: DataFrame, hops: int = 1, top_k: int = 20) -> DataFrame:
    """The surest triples within reach of the seeds: ``query_id``, ``triple_id``, ``rank``."""
    rows = reach(triples, seeds, hops).join(doubled(triples, "confidence", "validation_status"), "entity")
    rows = rows.select("query_id", "triple_id", "confidence", "validation_status").distinct()
    order = Window.partitionBy("query_id").orderBy(F.desc("confidence"), F.desc(F.col("validation_status") == "trusted"), "triple_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k)


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 1, most: int = 250) -> DataFrame:
    """Nodes at most ``depth`` steps from each seed over undirected ``source``,
    ``target`` edges, the nearest ``most``: ``query_id``, ``entity``, ``depth``."""
    triples = edges.select(F.col("source").alias("subject_id"), F.col("target").alias("object_id"), F.lit(0).alias("triple_id"))
    found = reach(triples, seeds, max(0, min(3, depth)))
    order = Window.partitionBy("query_id").orderBy("depth", "entity")
    return found.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= max(10, min(250, most))).drop("n")


def simple_edges(edges: DataFrame) -> DataFrame:
    """Different edges (``source``, ``relation``, ``target``) without loops."""
    return edges.filter("source <> target").dropDuplicates(["source", "relation", "target"])


def degrees(edges: DataFrame) -> DataFrame:
    both = edges.select(F.explode(F.array("source", "target")).alias("node"))
    return both.groupBy("node").agg(F.count("*").alias("degree"))


def edge_kind(anchor: Column, target_code: Column) -> Column:
    """navigation for targets without a code and for the anchors of page chrome, else flow."""
    words = F.trim(F.regexp_replace(F.coalesce(anchor, F.lit("")), r"\s+", " "))
    chrome = words.rlike(r"(?i)\b(index|table of contents|discussion)\b")
    return F.when((F.coalesce(target_code, F.lit("")) == "") | chrome, "navigation").otherwise("flow")


def navigate(pages: DataFrame, links: DataFrame, starts: DataFrame, fanout: int = 3, depth: int = 1, budget: int = 4) -> DataFrame:
    """Follow the best flow links from a start page, breadth first.

    pages: ``code``, ``summary``; links: ``source_code``, ``target_code``,
    ``anchor``, ``kind``; starts: ``query_id``, ``query``, ``code``. Links go to
    pages of the start's module, the best ``fanout`` of each page by the overlap
    with the query, then by code; at most ``budget`` pages for a query. The order
    of visits decides what later pages may follow, so each query's own part of
    the graph (found by joins) is walked in one scan of its links.
    """
    flow = links.filter(F.coalesce("kind", edge_kind(F.col("anchor"), F.col("target_code"))) == "flow")
    flow = flow.select(page_code("source_code").alias("src"), page_code("target_code").alias("dst"), "anchor")
    known = pages.select(page_code("code").alias("dst"), "summary").dropDuplicates(["dst"])
    flow = flow.join(known, "dst")
    front = starts.select("query_id", "query", page_code("code").alias("src"), module_of(page_code("code")).alias("module"))
    front = front.join(known.select(F.col("dst").alias("src")), "src", "left_semi")
    first, steps = front.select("query_id", F.col("src").alias("start")), None
    for hop in range(depth):
        step = front.join(flow, "src").filter(module_of("dst") == F.col("module"))
        score = F.round(overlap(token_set("query"), token_set(F.concat_ws(" ", "anchor", "dst", "summary"))), DIGITS)
        step = step.select("query_id", "query", "module", "src", "dst", score.alias("score")).distinct()
        part = step.select("query_id", "src", "dst", "score")
        steps = part if steps is None else steps.unionByName(part).distinct()
        front = step.select("query_id", "query", "module", F.col("dst").alias("src")).distinct()
    best = steps.groupBy("query_id", "src", "dst").agg(F.max("score").alias("score"))
    # A page's links beyond these are never followed: no more than budget + 1 pages are seen already.
    order = Window.partitionBy("query_id", "src").orderBy(F.desc("score"), "dst")
    best = best.withColumn("n", F.row_number().over(order)).filter(F.col("n") <= fanout + budget + 1).drop("n").join(first, "query_id")

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        ways: dict[str, list[str]] = {}
        for r in rows.sort_values(["score", "dst"], ascending=[False, True]).itertuples():
            ways.setdefault(r.src, []).append(r.dst)
        seen, queue, out = {rows["start"].iloc[0]}, [(rows["start"].iloc[0], 0)], []
        while queue and len(out) < budget:
            code, hop = queue.pop(0)
            if hop >= depth:
                continue
            followed = 0
            for dst in ways.get(code, ()):
                if dst not in seen and followed < fanout and len(out) < budget:
                    seen.add(dst)
                    out.append((dst, hop + 1))
                    queue.append((dst, hop + 1))
                    followed += 1
        return pd.DataFrame([(key[0], d, h, i + 1) for i, (d, h) in enumerate(out)], columns=["query_id", "code", "hop", "place"])

    kind = starts.schema["query_id"].dataType.simpleString()
    return best.groupBy("query_id").applyInPandas(walk, f"query_id {kind}, code string, hop long, place long")
