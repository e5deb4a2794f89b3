"""Graph operators over the foreign keys of the star schema and the links of ``pages``; triples from ``documents``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators import knowledge as K
from quarry.plans.search_queries import table


def key_triples(spark, sf_dir):
    """Regions, nations and suppliers as entities; a supplier's balance is the confidence."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    region = table(spark, sf_dir, "region")
    a = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.concat(F.lit("n"), "n_nationkey").alias("subject_id"),
        F.col("n_name").alias("subject_name"),
        F.lit("IN").alias("relation"),
        F.concat(F.lit("r"), "r_regionkey").alias("object_id"),
        F.col("r_name").alias("object_name"),
        F.lit("Region").alias("object_type"),
        F.lit(0.9).alias("confidence"),
        F.lit("guideline").alias("evidence_kind"),
        F.concat_ws(" ", "n_name", F.lit("should be preferred in"), "r_name").alias("evidence_text"),
    )
    b = supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("s"), "s_suppkey").alias("subject_id"),
        F.col("s_name").alias("subject_name"),
        F.lit("SUPPLIES").alias("relation"),
        F.concat(F.lit("n"), "n_nationkey").alias("object_id"),
        F.col("n_name").alias("object_name"),
        F.lit("Nation").alias("object_type"),
        F.round(F.pmod(F.col("s_acctbal"), F.lit(100.0)) / 100, 3).alias("confidence"),
        F.lit("text").alias("evidence_kind"),
        F.concat_ws(" ", "s_name", "n_name").alias("evidence_text"),
    )
    rows = a.unionByName(b).withColumn("triple_id", F.concat_ws("|", "subject_id", "relation", "object_id"))
    return rows.withColumns(
        {
            "validation_status": F.when(F.col("confidence") >= 0.75, "trusted").otherwise("needs_review"),
            "review_status": F.lit("auto"),
            "evidence_source_ids": F.array("subject_id", "object_id"),
        }
    )


def _seeds(spark, sf_dir):
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), F.concat(F.lit("r"), "r_regionkey").alias("entity"))


def graph_reach(spark, sf_dir):
    return G.reach(key_triples(spark, sf_dir), _seeds(spark, sf_dir), 2)


def graph_retrieve(spark, sf_dir):
    asked = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), F.concat(F.lit("suppliers in "), "r_name").alias("query"))
    return G.retrieve(key_triples(spark, sf_dir), _seeds(spark, sf_dir), asked, hops=1, top_k=20)


def graph_subgraph(spark, sf_dir):
    return G.subgraph(key_triples(spark, sf_dir), _seeds(spark, sf_dir), 1, 20).select("query_id", "triple_id", "rank")


def graph_neighbourhood(spark, sf_dir):
    edges = key_triples(spark, sf_dir).select(F.col("subject_id").alias("source"), F.col("object_id").alias("target"))
    return G.neighbourhood(edges, _seeds(spark, sf_dir), 2, 40)


def graph_navigation(spark, sf_dir):
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    pages = nation.select(F.concat(F.lit("K-N"), "n_nationkey").alias("code"), F.col("n_name").alias("summary")).unionByName(
        customer.select(F.concat(F.lit("K-C"), "c_custkey").alias("code"), F.col("c_mktsegment").alias("summary"))
    )
    links = customer.select(
        F.concat(F.lit("K-N"), "c_nationkey").alias("source_code"), F.concat(F.lit("K-C"), "c_custkey").alias("target_code"), F.col("c_mktsegment").alias("anchor"), F.lit("flow").alias("kind")
    )
    starts = nation.select(F.col("n_nationkey").cast("long").alias("query_id"), F.lit("building machinery").alias("query"), F.concat(F.lit("K-N"), "n_nationkey").alias("code"))
    return G.navigate(pages, links, starts, fanout=3, depth=2, budget=4)


def _hrefs(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.regexp_extract("url", r"://([^/]+)", 1).alias("source"), F.explode(F.regexp_extract_all("html", F.lit(r'href="([^"]+)"'), F.lit(1))).alias("target"))
    return rows.withColumn("relation", F.lit("links"))


def link_edges(spark, sf_dir):
    return G.simple_edges(_hrefs(spark, sf_dir)).select("source", "target")


def link_degrees(spark, sf_dir):
    return G.degrees(G.simple_edges(_hrefs(spark, sf_dir)))


#: Entities and cues for the invented languages of ``documents``.
ENTITIES = (
    K.Entity("Treatment", "The", (r"(^|\s)the(\s|$)",)),
    K.Entity("Disease", "Than", (r"(^|\s)than(\s|$)", r"(^|\s)that(\s|$)")),
    K.Entity("Test", "La", (r"(^|\s)la(\s|$)",)),
    K.Entity("Stage", "Der", (r"(^|\s)der(\s|$)", r"(^|\s)und(\s|$)")),
    K.Entity("Outcome", "De", (r"(^|\s)de(\s|$)",)),
)
CUES = {"RECOMMENDS": ("ing ", "tion"), "REQUIRES": ("ment", "keit"), "ASSOCIATED_WITH": ("is", "en")}
RULES = [("Treatment", "RECOMMENDS", "Disease"), ("Treatment", "REQUIRES", "Test"), ("Treatment", "ASSOCIATED_WITH", "Disease"), ("Test", "REQUIRES", "Outcome"), ("Test", "ASSOCIATED_WITH", "Outcome"), ("Stage", "REQUIRES", "Outcome")]


def _candidates(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("chunk_id"), "text", F.array("source").alias("source_ids"))
    return K.sentence_triples(chunks, ENTITIES, CUES)


def _rules(spark):
    return spark.createDataFrame(RULES, "subject_type string, relation string, object_type string")


def kg_validated(spark, sf_dir):
    good, _ = K.validate(_candidates(spark, sf_dir), _rules(spark))
    return good.groupBy("subject_id", "relation", "object_id", "validation_status").agg(F.count("*").alias("n"), F.round(F.sum("confidence"), 3).alias("confidence"))


def kg_rejected(spark, sf_dir):
    _, bad = K.validate(_candidates(spark, sf_dir), _rules(spark))
    return bad.groupBy("subject_id", "relation", "object_id").agg(F.count("*").alias("n"))


def kg_triples(spark, sf_dir):
    good, _ = K.validate(_candidates(spark, sf_dir), _rules(spark))
    return good.select("subject_id", "relation", "object_id", "confidence", F.array_join("evidence_source_ids", ",").alias("sources"), F.md5("evidence_text").alias("evidence"))


def kg_mentions(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("page_id"), "text")
    return K.mention_triples(pages, ENTITIES).groupBy("subject_id", "object_id").agg(F.count("*").alias("n"))


def kg_reviewed(spark, sf_dir):
    rows = key_triples(spark, sf_dir)
    asked = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), "s_suppkey", F.lit("|SUPPLIES|n"), "s_nationkey").alias("triple_id"),
        F.when(F.col("s_suppkey") % 3 == 0, "reject").when(F.col("s_suppkey") % 3 == 1, "approve").alias("decision"),
        F.lit(0.8).alias("new_confidence"),
        F.lit("seen").alias("note"),
        F.col("s_suppkey").alias("pos"),
    )
    decisions = K.last_decisions(asked.filter("decision is not null"))
    return K.apply_reviews(rows, decisions).select("triple_id", "confidence", "validation_status", "review_status", "evidence_text")


_TRIPLES = """
k AS (
  SELECT 'n' || n_nationkey AS s, n_name AS sn, 'IN' AS rel, 'r' || r_regionkey AS o, r_name AS onm, 'Region' AS ot, 0.9::DOUBLE AS c, 'guideline' AS kind, n_name || ' should be preferred in ' || r_name AS ev
  FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT 's' || s_suppkey, s_name, 'SUPPLIES', 'n' || n_nationkey, n_name, 'Nation', round((s_acctbal % 100 + 100) % 100 / 100, 3), 'text', s_name || ' ' || n_name
  FROM supplier JOIN nation ON s_nationkey = n_nationkey),
t AS (SELECT *, s || '|' || rel || '|' || o AS id, CASE WHEN c >= 0.75 THEN 'trusted' ELSE 'needs_review' END AS vs FROM k),
l AS (SELECT DISTINCT s AS a, o AS b FROM t UNION SELECT DISTINCT o, s FROM t),
d0 AS (SELECT CAST(r_regionkey AS BIGINT) AS query_id, 'r' || r_regionkey AS entity, 0 AS depth FROM region),
d1 AS (SELECT DISTINCT query_id, b AS entity, 1 AS depth FROM d0 JOIN l ON a = entity),
d2 AS (SELECT DISTINCT query_id, b AS entity, 2 AS depth FROM d1 JOIN l ON a = entity),
reach1 AS (SELECT query_id, entity, min(depth) AS depth FROM (FROM d0 UNION ALL FROM d1) GROUP BY ALL),
reach2 AS (SELECT query_id, entity, min(depth) AS depth FROM (FROM d0 UNION ALL FROM d1 UNION ALL FROM d2) GROUP BY ALL)"""

_TOKENS = "list_distinct(list_transform(regexp_extract_all({0}, '[a-zA-Z0-9]+'), lambda t: lower(t)))"
_SENTENCES = r"""
s0 AS (
  SELECT doc_id, source, list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^。！？!?\.]+[。！？!?\.]*'), lambda x: trim(x, ' ')), lambda x: x <> '') AS parts FROM documents),
s AS (SELECT doc_id, source, unnest(parts) AS sentence FROM s0),
e AS (
  SELECT *, lower(sentence) AS low,
    list_filter([CASE WHEN regexp_matches(sentence, '(?i)(^|\s)the(\s|$)') THEN 'treatment:the' END, CASE WHEN regexp_matches(sentence, '(?i)(^|\s)(than|that)(\s|$)') THEN 'disease:than' END,
      CASE WHEN regexp_matches(sentence, '(?i)(^|\s)la(\s|$)') THEN 'test:la' END, CASE WHEN regexp_matches(sentence, '(?i)(^|\s)(der|und)(\s|$)') THEN 'stage:der' END,
      CASE WHEN regexp_matches(sentence, '(?i)(^|\s)de(\s|$)') THEN 'outcome:de' END], lambda x: x IS NOT NULL) AS ents FROM s),
r AS (
  SELECT *, CASE WHEN contains(low, 'ing ') OR contains(low, 'tion') THEN 'RECOMMENDS' WHEN contains(low, 'ment') OR contains(low, 'keit') THEN 'REQUIRES' WHEN contains(low, 'is') OR contains(low, 'en') THEN 'ASSOCIATED_WITH' END AS relation FROM e),
c AS (
  SELECT doc_id, source, sentence, relation, ents[1] AS subject_id, unnest(ents[2:]) AS object_id FROM r WHERE relation IS NOT NULL AND len(ents) > 1),
f AS (
  SELECT *, (subject_id, relation, object_id) IN (VALUES ('treatment:the', 'RECOMMENDS', 'disease:than'), ('treatment:the', 'REQUIRES', 'test:la'), ('treatment:the', 'ASSOCIATED_WITH', 'disease:than'),
      ('test:la', 'REQUIRES', 'outcome:de'), ('test:la', 'ASSOCIATED_WITH', 'outcome:de'), ('stage:der', 'REQUIRES', 'outcome:de')) AS ok,
    CASE WHEN relation = 'ASSOCIATED_WITH' THEN 0.74 ELSE 0.83 + CASE WHEN length(sentence) < 120 THEN 0.03 ELSE 0 END END AS confidence FROM c)"""

QUERIES = {
    "graph_reach": graph_reach,
    "graph_retrieve": graph_retrieve,
    "graph_subgraph": graph_subgraph,
    "graph_neighbourhood": graph_neighbourhood,
    "graph_navigation": graph_navigation,
    "link_edges": link_edges,
    "link_degrees": link_degrees,
    "kg_validated": kg_validated,
    "kg_rejected": kg_rejected,
    "kg_triples": kg_triples,
    "kg_mentions": kg_mentions,
    "kg_reviewed": kg_reviewed,
}

ORACLE_SQL = {
    "graph_reach": f"WITH {_TRIPLES} SELECT query_id, entity, depth FROM reach2",
    "graph_retrieve": f"""
WITH {_TRIPLES},
a AS (
  SELECT query_id, id, min(depth) AS depth FROM reach1 JOIN (SELECT id, s AS e FROM t UNION SELECT id, o FROM t) x ON entity = e GROUP BY ALL),
q AS (SELECT CAST(r_regionkey AS BIGINT) AS query_id, 'suppliers in ' || r_name AS query, 'r' || r_regionkey AS seed FROM region),
b AS (
  SELECT *, lower(sn || ' ' || rel || ' ' || onm || ' ' || ot || ' ' || ev) AS blob, lower(ev) AS low FROM a JOIN t USING (id) JOIN q USING (query_id)),
v AS (
  SELECT *, round(least(1.0, len(list_intersect({_TOKENS.format('query')}, {_TOKENS.format('blob')})) / len({_TOKENS.format('query')}) + CASE WHEN contains(blob, 'preferred') THEN 0.15 ELSE 0 END), 6) AS relevance,
    greatest(0, least(1, c + CASE WHEN kind = 'guideline' THEN 0.18 ELSE 0.05 END + 0.03
      + CASE WHEN contains(low, lower(sn)) THEN 0.04 ELSE 0 END + CASE WHEN contains(low, lower(rel)) THEN 0.04 ELSE 0 END + CASE WHEN contains(low, lower(onm)) THEN 0.04 ELSE 0 END
      + CASE WHEN contains(low, 'should') THEN 0.05 ELSE 0 END + CASE WHEN s = seed OR o = seed THEN 0.10 ELSE 0 END + greatest(0, 0.08 - 0.04 * depth)
      + CASE WHEN vs = 'trusted' THEN 0.08 ELSE 0 END - 0.06 * depth - CASE WHEN vs = 'needs_review' THEN 0.10 ELSE 0 END - CASE WHEN length(ev) < 40 THEN 0.05 ELSE 0 END)) AS base FROM b),
z AS (SELECT query_id, id AS triple_id, c, round(least(1.0, base * 0.65 + relevance * 0.55), 6) AS score, relevance, depth FROM v WHERE relevance >= 0.06)
SELECT query_id, triple_id, score, relevance, depth, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, c DESC, triple_id) AS rank FROM z QUALIFY rank <= 20""",
    "graph_subgraph": f"""
WITH {_TRIPLES},
x AS (SELECT DISTINCT query_id, id AS triple_id, c, vs FROM reach1 JOIN t ON entity = s OR entity = o)
SELECT query_id, triple_id, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vs = 'trusted' DESC, triple_id) AS rank FROM x QUALIFY rank <= 20""",
    "graph_neighbourhood": f"WITH {_TRIPLES} SELECT query_id, entity, depth FROM reach2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY depth, entity) <= 40",
    "link_edges": """
SELECT DISTINCT regexp_extract(url, '://([^/]+)', 1) AS source, target FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages) WHERE regexp_extract(url, '://([^/]+)', 1) <> target""",
    "link_degrees": """
WITH e AS (SELECT DISTINCT regexp_extract(url, '://([^/]+)', 1) AS source, target FROM (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS target FROM pages))
SELECT node, count(*) AS degree FROM (SELECT source AS node FROM e WHERE source <> target UNION ALL SELECT target FROM e WHERE source <> target) GROUP BY node""",
    "kg_validated": f"""
WITH {_SENTENCES}
SELECT subject_id, relation, object_id, CASE WHEN confidence >= 0.75 THEN 'trusted' ELSE 'needs_review' END AS validation_status, count(*) AS n, round(sum(round(confidence, 3)), 3)::DOUBLE AS confidence
FROM f WHERE ok GROUP BY ALL""",
    "kg_rejected": f"WITH {_SENTENCES} SELECT subject_id, relation, object_id, count(*) AS n FROM f WHERE NOT ok GROUP BY ALL",
    "kg_triples": f"""
WITH {_SENTENCES} SELECT subject_id, relation, object_id, round(confidence, 3)::DOUBLE AS confidence, 'd' || doc_id || ',' || source AS sources, md5(sentence) AS evidence FROM f WHERE ok""",
    "kg_mentions": r"""
WITH e AS (
  SELECT list_filter([CASE WHEN regexp_matches(text, '(?i)(^|\s)the(\s|$)') THEN 'treatment:the' END, CASE WHEN regexp_matches(text, '(?i)(^|\s)(than|that)(\s|$)') THEN 'disease:than' END,
      CASE WHEN regexp_matches(text, '(?i)(^|\s)la(\s|$)') THEN 'test:la' END, CASE WHEN regexp_matches(text, '(?i)(^|\s)(der|und)(\s|$)') THEN 'stage:der' END,
      CASE WHEN regexp_matches(text, '(?i)(^|\s)de(\s|$)') THEN 'outcome:de' END], lambda x: x IS NOT NULL) AS ents FROM documents),
p AS (SELECT ents, unnest(range(1, len(ents) + 1)) AS i FROM e),
q AS (SELECT ents[i] AS subject_id, unnest(ents[i + 1:]) AS object_id FROM p)
SELECT subject_id, object_id, count(*) AS n FROM q GROUP BY ALL""",
    "kg_reviewed": f"""
WITH {_TRIPLES},
d AS (SELECT 's' || s_suppkey || '|SUPPLIES|n' || s_nationkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'reject' ELSE 'approve' END AS word FROM supplier WHERE s_suppkey % 3 <> 2)
SELECT t.id AS triple_id, CASE WHEN word IS NULL THEN c ELSE greatest(c, 0.8) END AS confidence, CASE WHEN word IS NULL THEN vs ELSE 'trusted' END AS validation_status,
  CASE WHEN word IS NULL THEN 'auto' ELSE 'human_trusted' END AS review_status, CASE WHEN word IS NULL THEN ev ELSE ev || chr(10) || '[review_note] seen' END AS evidence_text
FROM t LEFT JOIN d ON t.id = d.id WHERE word IS DISTINCT FROM 'reject'""",
    "graph_navigation": f"""
WITH l AS (
  SELECT CAST(n_nationkey AS BIGINT) AS query_id, 'K-C' || c_custkey AS code,
    round(len(list_intersect(['building', 'machinery'], {_TOKENS.format("c_mktsegment || ' K-C' || c_custkey || ' ' || c_mktsegment")})) / 2.0, 6) AS score
  FROM nation JOIN customer ON c_nationkey = n_nationkey)
SELECT query_id, code, CAST(1 AS BIGINT) AS hop, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, code) AS place FROM l QUALIFY place <= 3""",
}
