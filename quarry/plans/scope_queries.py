"""Scopes, gates and layout over ``documents``, ``benchmark``, ``part`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import citations as C
from quarry.operators import scope as P
from quarry.operators import search as S
from quarry.plans.search_queries import _bm25, questions, table

RULES = (P.ScopeRule("english", "(?i)th(at|er)", 100), P.ScopeRule("french", "(?i)eau", 102), P.ScopeRule("german", "(?i)schl?", 100), P.ScopeRule("spanish", "(?i)ciones", 90))


def detected_scopes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", P.detect_scope(F.col("text"), RULES).alias("scope"))


def _ids():
    return F.array(F.concat(F.lit("disc-"), "source", F.lit("-p1-c2")), F.concat(F.lit("page-"), F.upper("lang"), F.lit("-3")), F.concat(F.lit("page-"), "doc_id"))


def parsed_sources(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(_ids()).alias("at", "id"))
    return rows.select("doc_id", "at", P.parse_source_id(F.col("id"))["article"].alias("article"), P.parse_source_id(F.col("id"))["module"].alias("module"))


def scope_verdicts(spark, sf_dir):
    ids = F.when(F.col("doc_id") % 3 == 0, F.slice(_ids(), 3, 1)).otherwise(_ids())
    verdict = P.scope_verdict(ids, F.array(F.lit("src1"), F.lit("src2")), F.array(F.lit("DE")))
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(verdict.cast("string"), F.lit("unknown")).alias("verdict"))


def _hits(spark, sf_dir, k):
    docs = table(spark, sf_dir, "documents")
    hits = S.bm25_search(docs, questions(spark, sf_dir), k)
    return hits.join(docs.select("doc_id", "text", "lang", "source"), "doc_id").join(questions(spark, sf_dir), "query_id")


def gated_hits(spark, sf_dir):
    return P.lexical_gate(_hits(spark, sf_dir, 8)).select("query_id", "doc_id", "rank", "overlap")


def guarded_hits(spark, sf_dir):
    return P.unless_empty(_hits(spark, sf_dir, 8), F.col("source").isin("src1", "src2")).select("query_id", "doc_id", "rank")


def injected_hits(spark, sf_dir):
    all_ = _hits(spark, sf_dir, 12).select("query_id", "doc_id", "rank", "source")
    return P.inject(all_.filter("rank <= 3"), all_, 2, F.col("source").isin("src1", "src2", "src3", "src4", "src5", "src6")).select("query_id", "doc_id", "rank")


def candidate_pages(spark, sf_dir):
    hits = _hits(spark, sf_dir, 6)
    a = hits.filter("rank <= 3").select("query_id", F.col("source").alias("item"), F.col("rank").alias("place"))
    b = hits.select("query_id", F.col("source").alias("item"), F.col("rank").alias("place"))
    c = hits.select("query_id", F.col("lang").alias("item"), F.col("rank").alias("place"))
    return P.ordered_union([c, a, b], 5)


def selected_pages(spark, sf_dir):
    """Sources are pages, of the kind that their documents' language stands for; the ones asked for are those of a question's second and fifth hits in English."""
    hits = _hits(spark, sf_dir, 6).withColumn("item", F.col("source"))
    kind = F.when(F.col("lang") == "fr", "decision").when(F.col("lang") == "de", "table").when(F.col("lang") == "en", "guideline").otherwise("other")
    found = hits.select("query_id", "item", F.col("rank").alias("place"), kind.alias("kind"))
    asked = hits.filter("rank in (2, 5) and lang = 'en' and query_id % 2 = 0").select("query_id", "item", F.col("rank").alias("place"))
    return P.selected_pages(found, asked, 3, ("decision", "table", "guideline"))


def evidence_numbers(spark, sf_dir):
    hits = _hits(spark, sf_dir, 3)
    a = hits.select("query_id", F.concat(F.lit("d"), "doc_id").alias("key"), F.col("rank").alias("place"))
    b = hits.select("query_id", F.col("source").alias("key"), F.col("rank").alias("place"))
    return C.display_index([a, b]).select("query_id", "key", "place", "list", "number")


def figure_anchors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "text"))
    figures = docs.select("doc_id", F.explode(F.array(F.lit("icense"), F.lit("@mail"), F.lit(" | "))).alias("label")).withColumn("figure", F.md5("label"))
    return P.first_mentions(figures, lines)


def _boxes(spark, sf_dir):
    x, y = F.col("l_quantity"), F.col("l_extendedprice") / 1000
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_suppkey").alias("page"), (F.col("l_orderkey") * 1000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("box"), "l_linenumber", x.alias("x0"), y.alias("y0"), (x + 5).alias("x1"), (y + 10 * F.col("l_discount") + 1).alias("y1"))


def box_unions(spark, sf_dir):
    out = P.box_union(_boxes(spark, sf_dir), "page")
    return out.select("page", *(F.round(c, 6).alias(c) for c in ("x0", "y0", "x1", "y1", "area")))


def box_overlaps(spark, sf_dir):
    rows = _boxes(spark, sf_dir)
    links = rows.filter("l_linenumber = 1").withColumnRenamed("box", "link_id")
    blocks = rows.filter("l_linenumber > 1").withColumnRenamed("box", "block_id")
    out = P.best_overlap(links, blocks, cell=10.0)
    return out.select("link_id", "block_id", F.round("area", 6).alias("area"))


def box_qualities(spark, sf_dir):
    rows = _boxes(spark, sf_dir)
    return rows.groupBy(P.box_quality(F.col("x0") / 60, F.col("y0") / 120, F.col("x1") / 60, F.col("y1") / 120).alias("quality")).agg(F.count("*").alias("n"))


def display_lines(spark, sf_dir):
    title = F.split_part("text", F.lit("\n"), F.lit(1))
    year = F.when(F.col("doc_id") % 2 == 0, (F.col("doc_id") % 30 + 1990).cast("string"))
    kind = F.when(F.col("lang") == "en", "reference").otherwise("page")
    return table(spark, sf_dir, "documents").select("doc_id", P.display_title(kind, title, F.col("source"), year).alias("line"))


_B = "b AS (SELECT l_suppkey AS page, l_orderkey * 1000 + l_partkey * 10 + l_linenumber AS box, l_linenumber AS ln, l_quantity AS x0, l_extendedprice / 1000 AS y0, l_quantity + 5 AS x1, l_extendedprice / 1000 + 10 * l_discount + 1 AS y1 FROM lineitem)"

QUERIES = {
    "detected_scopes": detected_scopes,
    "parsed_sources": parsed_sources,
    "scope_verdicts": scope_verdicts,
    "gated_hits": gated_hits,
    "guarded_hits": guarded_hits,
    "injected_hits": injected_hits,
    "candidate_pages": candidate_pages,
    "selected_pages": selected_pages,
    "evidence_numbers": evidence_numbers,
    "figure_anchors": figure_anchors,
    "box_unions": box_unions,
    "box_overlaps": box_overlaps,
    "box_qualities": box_qualities,
    "display_lines": display_lines,
}

ORACLE_SQL = {
    "detected_scopes": """
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)eau') THEN 'french' WHEN regexp_matches(text, '(?i)th(at|er)') THEN 'english' WHEN regexp_matches(text, '(?i)schl?') THEN 'german'
  WHEN regexp_matches(text, '(?i)ciones') THEN 'spanish' ELSE 'all' END AS scope FROM documents""",
    "parsed_sources": """
SELECT doc_id, i AS "at", CASE WHEN i = 0 THEN source END AS article, CASE WHEN i = 1 THEN upper(lang) END AS module FROM documents CROSS JOIN (SELECT unnest([0, 1, 2]) AS i)""",
    "scope_verdicts": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'unknown' WHEN source IN ('src1', 'src2') OR lang = 'de' THEN 'true' ELSE 'false' END AS verdict FROM documents",
    "gated_hits": f"""
WITH {_bm25(8)},
t AS (SELECT item_id AS query_id, list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda x: lower(x))) AS qs FROM benchmark),
o AS (SELECT query_id, doc_id, rank, round(len(list_intersect(qs, list_distinct(list_transform(regexp_extract_all(text, '[a-zA-Z0-9]+'), lambda x: lower(x))))) / greatest(len(qs), 1), 6)::DOUBLE AS overlap FROM h JOIN documents USING (doc_id) JOIN t USING (query_id))
SELECT * FROM o WHERE overlap > 0 OR rank <= 2""",
    "guarded_hits": f"""
WITH {_bm25(8)}, x AS (SELECT query_id, doc_id, rank, source IN ('src1', 'src2') AS k FROM h JOIN documents USING (doc_id))
SELECT query_id, doc_id, rank FROM x QUALIFY k OR NOT bool_or(k) OVER (PARTITION BY query_id)""",
    "injected_hits": f"""
WITH {_bm25(12)},
x AS (SELECT query_id, doc_id, rank, source IN ('src1', 'src2', 'src3', 'src4', 'src5', 'src6') AS k FROM h JOIN documents USING (doc_id)),
lost AS (SELECT query_id FROM x WHERE rank <= 3 GROUP BY query_id HAVING NOT bool_or(k)),
n AS (SELECT query_id, doc_id, rank FROM x WHERE rank > 3 AND k AND query_id IN (SELECT query_id FROM lost) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rank, doc_id) <= 2)
SELECT query_id, doc_id, rank FROM x WHERE rank <= 3 UNION ALL SELECT * FROM n""",
    "candidate_pages": f"""
WITH {_bm25(6)}, x AS (SELECT query_id, rank, source, lang FROM h JOIN documents USING (doc_id)),
u AS (SELECT query_id, lang AS item, rank AS place, 0 AS l FROM x UNION ALL SELECT query_id, source, rank, 1 FROM x WHERE rank <= 3 UNION ALL SELECT query_id, source, rank, 2 FROM x),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, item ORDER BY l, place) = 1)
SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY l, place, item) AS position FROM f QUALIFY position <= 5""",
    "selected_pages": f"""
WITH {_bm25(6)}, x AS (SELECT query_id, rank, source AS item, lang FROM h JOIN documents USING (doc_id)),
c AS (SELECT query_id, item, arg_min(CASE lang WHEN 'fr' THEN 'decision' WHEN 'de' THEN 'table' WHEN 'en' THEN 'guideline' ELSE 'other' END, rank) AS kind, min(rank) AS met FROM x GROUP BY ALL),
r AS (SELECT query_id, item, min(rank) AS asked FROM x WHERE rank IN (2, 5) AND lang = 'en' AND query_id % 2 = 0 GROUP BY ALL),
t AS (SELECT *, CASE WHEN asked IS NOT NULL THEN 0 ELSE list_position(['decision', 'table', 'guideline'], kind) END AS tier FROM c LEFT JOIN r USING (query_id, item)),
m AS (SELECT * FROM t WHERE tier IS NOT NULL QUALIFY tier = min(tier) OVER (PARTITION BY query_id))
SELECT query_id, item, kind, CAST(tier AS INT) AS tier, row_number() OVER (PARTITION BY query_id ORDER BY coalesce(asked, met), item) AS position FROM m
QUALIFY position <= CASE WHEN tier = 0 THEN 3 ELSE 2 END""",
    "evidence_numbers": f"""
WITH {_bm25(3)}, x AS (SELECT query_id, doc_id, rank, source FROM h JOIN documents USING (doc_id)),
u AS (SELECT query_id, 'd' || doc_id AS key, rank AS place, 0 AS list FROM x UNION ALL SELECT query_id, source, rank, 1 FROM x)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY list, place, key) AS number FROM u""",
    "figure_anchors": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents)
SELECT doc_id, md5(label) AS figure, CAST(min(i) AS INT) AS anchor FROM l, (SELECT unnest(['icense', '@mail', ' | ']) AS label) WHERE contains(line, label) GROUP BY doc_id, label""",
    "box_unions": f"WITH {_B} SELECT page, round(min(x0), 6) AS x0, round(min(y0), 6) AS y0, round(max(x1), 6) AS x1, round(max(y1), 6) AS y1, round((max(x1) - min(x0)) * (max(y1) - min(y0)), 6) AS area FROM b GROUP BY page",
    "box_overlaps": f"""
WITH {_B},
o AS (
  SELECT l.box AS link_id, k.box AS block_id, greatest(0, least(l.x1, k.x1) - greatest(l.x0, k.x0)) * greatest(0, least(l.y1, k.y1) - greatest(l.y0, k.y0)) AS area FROM b l JOIN b k ON l.page = k.page WHERE l.ln = 1 AND k.ln > 1)
SELECT link_id, block_id, round(area, 6) AS area FROM o WHERE area > 0 QUALIFY row_number() OVER (PARTITION BY link_id ORDER BY area DESC, block_id) = 1""",
    "box_qualities": f"""
WITH {_B}, n AS (SELECT x0 / 60 AS x0, y0 / 120 AS y0, x1 / 60 AS x1, y1 / 120 AS y1 FROM b)
SELECT CASE WHEN x1 - x0 <= 0 OR y1 - y0 <= 0 OR least(x0, y0) < 0 OR greatest(x1, y1) > 1 THEN 'invalid' WHEN (x1 - x0) * (y1 - y0) > 0.9 THEN 'full_page' WHEN least(x1 - x0, y1 - y0) < 0.05 THEN 'narrow' ELSE 'good' END AS quality, count(*) AS n FROM n GROUP BY ALL""",
    "display_lines": """
SELECT doc_id, CASE WHEN lang = 'en' THEN concat_ws(' · ', source, CASE WHEN doc_id % 2 = 0 THEN CAST(doc_id % 30 + 1990 AS VARCHAR) END, split_part(text, chr(10), 1)) ELSE concat_ws(' · ', split_part(text, chr(10), 1), source) END AS line FROM documents""",
}
