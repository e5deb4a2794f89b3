"""Entities and scopes of questions, staged graph search and roll-ups over ``benchmark``, ``documents`` and the star schema; page layout over ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import graph as G
from quarry.operators import layout as L
from quarry.operators import resolution as X
from quarry.operators import rules as R
from quarry.operators import search as S
from quarry.operators.knowledge import Entity
from quarry.plans import graph_queries as Q
from quarry.plans.graph_queries import _seeds, key_triples
from quarry.plans.scope_queries import ORACLE_SQL as SCOPE_SQL
from quarry.plans.scope_queries import RULES
from quarry.plans.search_queries import TERMS, TOKENS, _bm25, questions, table

#: Entities in the invented languages of the tables; "the" is a pattern of two of them, of which the last holds.
ENTITIES = (Entity("Test", "The", ("the", "th[ae]n")), Entity("Stage", "Und", ("und", "ung$")), Entity("Outcome", "De", ("de", "the")))
PHRASES = {"tion": "Und", "ment": "missing", "than": "De"}
HINTS = {"the": "under that", "la": "les eau", "und": "schen"}
TERM_LIST = ("the", "Than", "ou")
CONTEXTS = ((r"^T", "outcome"), (r"^o", "la der"))
WORDS = "[A-Z][a-z]{2}"
SCOPES = [("english", ["EN"], ["src1", "src2", "src3", "src4"]), ("french", ["FR", "EN"], []), ("german", [], ["src5"]), ("all", [], [])]
COMMON = ("DE",), ("src6",)
ROUTES = {"flow": ("therapy", "the"), "evidence": ("reference", "das")}


def query_entities(spark, sf_dir):
    return X.resolve_entities(questions(spark, sf_dir), ENTITIES, PHRASES)


def query_expansion(spark, sf_dir):
    rows = X.expand_queries(questions(spark, sf_dir), HINTS, WORDS, TERM_LIST, CONTEXTS)
    return rows.select("query_id", F.array_join("entities", ",").alias("entities"), F.array_join("searches", "|").alias("searches"))


def _scopes(spark):
    return S.with_common(spark.createDataFrame(SCOPES, "scope string, modules array<string>, articles array<string>"), *COMMON)


def scoped_search(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("lang") == "en", "discussion").otherwise("clinical_guideline").alias("page_type"), F.upper("lang").alias("module_code"), F.col("source").alias("article_id"))
    asked = questions(spark, sf_dir).withColumn("searches", F.array("query", F.lit("under that the")))
    hits = S.retrieve(docs, asked, _scopes(spark), RULES, **ROUTES)
    return hits.select("query_id", "doc_id", "scope", "route", F.array_join("triggers", ",").alias("triggers"), "pre_rerank_score", "score", "rank")


def _edges(spark, sf_dir):
    supplier, nation, region = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    nodes = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.col("n_name").alias("name"), F.lit("Nation").alias("kind"))
    nodes = nodes.unionByName(region.select(F.concat(F.lit("r"), "r_regionkey").alias("node"), F.col("r_name").alias("name"), F.lit("Region").alias("kind")))
    # Every third supplier has no name of its own.
    name = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("s"), "s_suppkey")).otherwise(F.col("s_name"))
    nodes = nodes.unionByName(supplier.select(F.concat(F.lit("s"), "s_suppkey").alias("node"), name.alias("name"), F.lit("Supplier").alias("kind")))
    edges = supplier.select(F.concat_ws("-", F.lit("s"), "s_suppkey").alias("edge_id"), F.concat(F.lit("s"), "s_suppkey").alias("source"), F.when(F.col("s_suppkey") % 2 == 0, "EDGE").otherwise("SUPPLIES").alias("relation"), F.concat(F.lit("n"), "s_nationkey").alias("target"))
    return edges.unionByName(nation.select(F.concat_ws("-", F.lit("n"), "n_nationkey").alias("edge_id"), F.concat(F.lit("n"), "n_nationkey").alias("source"), F.lit("IN").alias("relation"), F.concat(F.lit("r"), "n_regionkey").alias("target"))), nodes


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), F.concat(F.lit("suppliers in "), "r_name").alias("query"))


def _edge_hits(spark, sf_dir):
    edges, nodes = _edges(spark, sf_dir)
    near = G.reach(key_triples(spark, sf_dir), _seeds(spark, sf_dir), 1)
    return X.edge_triples(edges, nodes, _asked(spark, sf_dir), near)


def graph_edges(spark, sf_dir):
    return _edge_hits(spark, sf_dir).select("query_id", "triple_id", "subject_name", "relation", "object_name", "confidence", "score")


def staged_graph(spark, sf_dir):
    triples = key_triples(spark, sf_dir)
    first = G.retrieve(triples, _seeds(spark, sf_dir), _asked(spark, sf_dir), hops=1, top_k=20).join(triples.select("triple_id", "confidence"), "triple_id")
    around = X.expanded_hits(G.subgraph(triples, _seeds(spark, sf_dir), 1, 20), triples)
    return X.merge_hits([first, around, _edge_hits(spark, sf_dir)], 40)


def seed_candidates(spark, sf_dir):
    hits = S.bm25_search(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 6).join(table(spark, sf_dir, "documents").select("doc_id", "source", "lang"), "doc_id")
    triples = hits.select("query_id", "rank", F.concat(F.lit("d"), F.col("doc_id") % 7).alias("subject_name"), F.col("source").alias("object_name"))
    pages = hits.select("query_id", "rank", F.concat_ws("-", "lang", "rank").alias("code"), F.col("lang").alias("module"))
    return X.seed_candidates(triples, pages, query_entities(spark, sf_dir).select("query_id", "name"))


def _chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.coalesce("source", F.lit("none")).alias("article_id"), F.col("doc_id").alias("pos"), F.when(F.col("doc_id") % 3 > 0, F.split_part("text", F.lit("\n"), F.lit(1))).alias("title"), F.transform(F.array(F.lit(2), F.lit(0), F.lit(1)), lambda k: (F.col("doc_id") % 40 + k).cast("int")).alias("reference_ids"))


def _entries(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select(F.concat(F.lit("src"), F.col("p_partkey") % 30).alias("article_id"), F.col("p_size").alias("ref_number"), F.concat(F.lit("ref-"), "p_partkey").alias("entry_id"))


def article_rollup(spark, sf_dir):
    return X.article_rollup(_chunks(spark, sf_dir), _entries(spark, sf_dir))


def chunk_sources(spark, sf_dir):
    rows = X.chunk_sources(_chunks(spark, sf_dir), _entries(spark, sf_dir))
    return rows.select("chunk_id", F.array_join("source_ids", ",").alias("source_ids"))


def _blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_suppkey").alias("page"), F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.max(F.concat("l_returnflag", "l_linestatus")).alias("mode"))
    return rows.select("page", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("block_id"), F.col("q").alias("x0"), (F.col("q") * (1 + 20 * F.col("d"))).alias("x1"), (F.col("l_orderkey") % 100).cast("double").alias("y0"), F.concat_ws("-", "mode", "l_linenumber").alias("text"))


def reading_lanes(spark, sf_dir):
    return L.reading_order(_blocks(spark, sf_dir), F.lit(30.0)).select("page", "block_id", "lane", "place")


def footer_codes(spark, sf_dir):
    return L.footer_codes(_blocks(spark, sf_dir), F.lit(60.0), F.lit(100.0))


def _dictionary(spark, sf_dir):
    """Each question's first two and first three words are rules; the former capture two words."""
    words = R.rule_words("query")
    rules = questions(spark, sf_dir).select("query_id", F.explode(F.array(F.lit(2), F.lit(3))).alias("n"), words.alias("w"))
    rules = rules.filter(F.size("w") >= F.col("n"))
    return rules.select((F.col("query_id") * 10 + F.col("n")).alias("rule"), F.array_join(F.slice("w", 1, F.col("n")), " ").alias("alias"), F.col("query_id").alias("concept"), F.when(F.col("n") == 2, 2).alias("capture"))


def rule_matches(spark, sf_dir):
    return R.rule_matches(table(spark, sf_dir, "documents"), _dictionary(spark, sf_dir))


def rule_concepts(spark, sf_dir):
    return R.concepts(R.longest_matches(R.rule_matches(table(spark, sf_dir, "documents"), _dictionary(spark, sf_dir))))


_RULE_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*')"
_RULES = f"""
d AS (SELECT doc_id, {_RULE_WORDS} AS w FROM documents),
u AS (SELECT item_id * 10 + n AS rule, item_id AS concept, n, CASE WHEN n = 2 THEN 2 ELSE 0 END AS capture, list_aggregate(w[1:n], 'string_agg', ' ') AS alias
  FROM (SELECT item_id, {_RULE_WORDS} AS w FROM benchmark), (SELECT unnest([2, 3]) AS n) WHERE len(w) >= n),
e AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM d),
g AS (SELECT doc_id, i, n, list_aggregate(w[i + 1:i + n], 'string_agg', ' ') AS alias, w[i + n + 1:i + n + 2] AS tail FROM e, (SELECT unnest([2, 3]) AS n) WHERE i + n <= len(w)),
m AS (SELECT doc_id, rule, concept, CAST(i AS INT) AS "at", CAST(u.n AS INT) AS n_words, CASE WHEN capture = 2 AND len(tail) = 2 THEN list_aggregate(tail, 'string_agg', ' ') END AS captured FROM g JOIN u ON g.alias = u.alias AND g.n = u.n)"""

QUERIES = {
    "rule_matches": rule_matches,
    "rule_concepts": rule_concepts,
    "query_entities": query_entities,
    "query_expansion": query_expansion,
    "scoped_search": scoped_search,
    "graph_edges": graph_edges,
    "staged_graph": staged_graph,
    "seed_candidates": seed_candidates,
    "article_rollup": article_rollup,
    "chunk_sources": chunk_sources,
    "reading_lanes": reading_lanes,
    "footer_codes": footer_codes,
}


_WORDS = r"list_filter(regexp_split_to_array(text, '[\s,，?？]+'), lambda w: w <> '')"
_NAMED = f"""
et AS (SELECT item_id AS query_id, unnest(list_distinct(list_concat({TOKENS.format('text')}, {_WORDS}))) AS term FROM benchmark),
eh AS (
  SELECT DISTINCT query_id, CASE WHEN regexp_matches(term, '(?i)the') THEN 'De' WHEN regexp_matches(term, '(?i)th[ae]n') THEN 'The' WHEN regexp_matches(term, '(?i)und|ung$') THEN 'Und'
    WHEN regexp_matches(term, '(?i)de') THEN 'De' END AS name FROM et),
ek AS (SELECT * FROM eh WHERE name IS NOT NULL),
en AS (
  SELECT * FROM ek UNION
  SELECT item_id, name FROM benchmark JOIN (SELECT unnest(['The', 'Und', 'De']) AS name) ON contains(lower(text), lower(name)) WHERE item_id NOT IN (SELECT query_id FROM ek) UNION
  SELECT item_id, 'Und' FROM benchmark WHERE contains(lower(text), 'tion') UNION
  SELECT item_id, 'De' FROM benchmark WHERE contains(lower(text), 'than'))"""
_EDGES = """
ed AS (
  SELECT 's-' || s_suppkey AS eid, 's' || s_suppkey AS src, CASE WHEN s_suppkey % 2 = 0 THEN 'EDGE' ELSE 'SUPPLIES' END AS erel, 'n' || s_nationkey AS dst, CASE WHEN s_suppkey % 3 <> 0 THEN s_name END AS en, n_name AS dn
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
  UNION ALL SELECT 'n-' || n_nationkey, 'n' || n_nationkey, 'IN', 'r' || n_regionkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
ex AS (SELECT DISTINCT query_id, ed.* FROM ed JOIN reach1 ON entity = src OR entity = dst WHERE en IS NOT NULL),
eg AS (
  SELECT query_id, 'edge:' || eid AS triple_id, en AS subject_name, erel AS relation, dn AS object_name, CASE WHEN erel = 'EDGE' THEN 0.66 ELSE 0.8 END::DOUBLE AS confidence,
    lower('suppliers in ' || r_name) AS low FROM ex JOIN region ON r_regionkey = query_id),
es AS (
  SELECT * EXCLUDE (low), round(confidence + CASE WHEN contains(low, lower(subject_name)) OR contains(low, lower(object_name)) THEN 0.08 ELSE 0 END, 6) AS score FROM eg)"""
_ORDERED = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_BLOCKS = """
b AS (
  SELECT max(l_suppkey) AS page, l_orderkey * 10 + l_linenumber AS block_id, max(l_quantity) AS x0, max(l_quantity) * (1 + 20 * max(l_discount)) AS x1, CAST(l_orderkey % 100 AS DOUBLE) AS y0,
    max(l_returnflag || l_linestatus) || '-' || l_linenumber AS text FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
_CHUNKS = """
c AS (
  SELECT doc_id, 'c' || doc_id AS chunk_id, coalesce(source, 'none') AS article_id, CASE WHEN doc_id % 3 > 0 THEN split_part(text, chr(10), 1) END AS title, [doc_id % 40 + 2, doc_id % 40, doc_id % 40 + 1] AS refs FROM documents),
r AS (SELECT 'src' || p_partkey % 30 AS article_id, p_size AS ref, 'ref-' || p_partkey AS entry_id FROM part)"""
_SEARCHED = _bm25(40).replace("unnest(" + TERMS.format("text") + ") AS term FROM benchmark", "unnest(" + TERMS.format("text || ' under that the'") + ") AS term FROM benchmark").replace("h AS (", "h0 AS (")

ORACLE_SQL = {
    "rule_matches": f"WITH {_RULES} SELECT * FROM m",
    "rule_concepts": f"""
WITH {_RULES}, l AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, "at" ORDER BY n_words DESC, rule) = 1)
SELECT doc_id, concept, count(*) AS n, min("at") AS first_at, arg_min(captured, "at") FILTER (WHERE captured IS NOT NULL) AS captured FROM l GROUP BY doc_id, concept""",
    "query_entities": f"WITH {_NAMED} SELECT DISTINCT query_id, CASE name WHEN 'The' THEN 'test:the' WHEN 'Und' THEN 'stage:und' ELSE 'outcome:de' END AS entity, name FROM en",
    "query_expansion": f"""
WITH q AS (
  SELECT item_id AS query_id, trim(text) AS q, list_sort(list_distinct(list_concat(regexp_extract_all(trim(text), '{WORDS}'), list_filter(['the', 'Than', 'ou'], lambda t: contains(lower(text), lower(t)))))) AS ents FROM benchmark),
l AS (
  SELECT query_id, ents, list_filter(list_transform(list_concat([q, CASE WHEN contains(q, 'the') THEN 'under that' END, CASE WHEN contains(q, 'la') THEN 'les eau' END, CASE WHEN contains(q, 'und') THEN 'schen' END, array_to_string(ents, ' ')],
    list_transform(ents, lambda e: CASE WHEN regexp_matches(e, '^T') THEN e || ' outcome' WHEN regexp_matches(e, '^o') THEN e || ' la der' END)), lambda s: trim(coalesce(s, ''))), lambda s: s <> '') AS s FROM q)
SELECT query_id, array_to_string(ents, ',') AS entities, array_to_string({_ORDERED.format('s')}, '|') AS searches FROM l""",
    "scoped_search": f"""
WITH {_SEARCHED},
sc AS ({SCOPE_SQL['detected_scopes'].replace('doc_id', 'item_id AS query_id').replace('FROM documents', 'FROM benchmark')}),
bound AS (
  SELECT query_id, scope, CASE scope WHEN 'english' THEN ['EN', 'DE'] WHEN 'french' THEN ['FR', 'EN', 'DE'] WHEN 'german' THEN ['DE'] ELSE [] END AS ms,
    CASE scope WHEN 'english' THEN ['src1', 'src2', 'src3', 'src4', 'src6'] WHEN 'french' THEN ['src6'] WHEN 'german' THEN ['src5', 'src6'] ELSE [] END AS ars FROM sc),
h AS (
  SELECT s.*, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s JOIN d USING (doc_id) JOIN bound USING (query_id)
  WHERE score > 0 AND CASE WHEN lang = 'en' THEN len(ars) = 0 OR coalesce(list_contains(ars, source), false) ELSE len(ms) = 0 OR coalesce(list_contains(ms, upper(lang)), false) END QUALIFY rank <= 16),
o AS (
  SELECT query_id, h.doc_id, score AS pre_rerank_score,
    round(score + round(len(list_intersect({TOKENS.format('b.text')}, {TOKENS.format('d.text')})) / greatest(len({TOKENS.format('b.text')}), 1), 6), 6) AS score
  FROM h JOIN d ON h.doc_id = d.doc_id JOIN benchmark b ON b.item_id = query_id),
w AS (
  SELECT item_id AS query_id, list_filter(['therapy', 'the'], lambda w: contains(lower(text), w)) AS f, list_filter(['reference', 'das'], lambda w: contains(lower(text), w)) AS e FROM benchmark)
SELECT query_id, doc_id, scope, CASE WHEN len(f) > 0 AND len(e) > 0 THEN 'hybrid' WHEN len(f) > 0 THEN 'flowchart' ELSE 'evidence' END AS route, array_to_string(list_sort(list_distinct(list_concat(f, e))), ',') AS triggers,
  pre_rerank_score, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM o JOIN bound USING (query_id) JOIN w USING (query_id) QUALIFY rank <= 6""",
    "graph_edges": f"WITH {Q._TRIPLES}, {_EDGES} SELECT * FROM es",
    "staged_graph": f"""
WITH {Q._TRIPLES}, {_EDGES},
u AS (
  SELECT query_id, triple_id, score, c AS confidence, 0 AS stage FROM ({Q.ORACLE_SQL['graph_retrieve']}) x JOIN t ON t.id = triple_id
  UNION ALL SELECT query_id, triple_id, 0.84, c, 1 FROM ({Q.ORACLE_SQL['graph_subgraph']}) x JOIN t ON t.id = triple_id
  UNION ALL SELECT query_id, triple_id, score, confidence, 2 FROM es),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY query_id, triple_id ORDER BY score DESC, confidence DESC, stage) = 1)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, confidence DESC, stage, triple_id) AS rank FROM f QUALIFY rank <= 40""",
    "seed_candidates": f"""
WITH {_bm25(6)}, {_NAMED},
x AS (SELECT query_id, doc_id, rank, source, lang FROM h JOIN documents USING (doc_id)),
u AS (
  SELECT query_id, 'd' || doc_id % 7 AS item, rank * 2 AS place, 0 AS l FROM x UNION ALL SELECT query_id, source, rank * 2 + 1, 0 FROM x
  UNION ALL SELECT query_id, lang || '-' || rank, rank * 2, 1 FROM x WHERE rank <= 4 UNION ALL SELECT query_id, lang, rank * 2 + 1, 1 FROM x WHERE rank <= 4
  UNION ALL SELECT query_id, name, 0, 2 FROM (SELECT DISTINCT query_id, name FROM en)),
f AS (SELECT * FROM u WHERE trim(item) <> '' QUALIFY row_number() OVER (PARTITION BY query_id, item ORDER BY l, place) = 1)
SELECT query_id, item, row_number() OVER (PARTITION BY query_id ORDER BY l, place, item) AS position FROM f QUALIFY position <= 8""",
    "article_rollup": f"""
WITH {_CHUNKS},
a AS (SELECT article_id, count(*) AS n, arg_min(title, doc_id) FILTER (title <> '') AS title FROM c GROUP BY article_id),
m AS (SELECT article_id, count(DISTINCT ref) AS k FROM (SELECT article_id, unnest(refs) AS ref FROM c UNION ALL SELECT article_id, ref FROM r) GROUP BY article_id)
SELECT article_id, coalesce(title, article_id) AS title, coalesce(n, 0) AS chunk_count, coalesce(k, 0) AS reference_count FROM a FULL JOIN m USING (article_id)""",
    "chunk_sources": f"""
WITH {_CHUNKS},
e AS (SELECT article_id, ref, max(entry_id) AS entry_id FROM r GROUP BY ALL),
p AS (SELECT chunk_id, article_id, unnest(refs) AS ref, generate_subscripts(refs, 1) AS i FROM c),
g AS (SELECT chunk_id, string_agg(entry_id, ',' ORDER BY i) AS s FROM p JOIN e ON p.article_id = e.article_id AND p.ref = e.ref GROUP BY chunk_id)
SELECT chunk_id, chunk_id || coalesce(',' || s, '') AS source_ids FROM c LEFT JOIN g USING (chunk_id)""",
    "reading_lanes": f"""
WITH {_BLOCKS}, n AS (SELECT *, CASE WHEN x0 < 30.0 * 0.55 AND x1 > 30.0 * 1.35 THEN 'full' WHEN (x0 + x1) / 2 <= 30.0 THEN 'left' ELSE 'right' END AS lane FROM b)
SELECT page, block_id, lane, row_number() OVER (PARTITION BY page ORDER BY list_position(['full', 'left', 'right'], lane), y0, block_id) AS place FROM n""",
    "footer_codes": f"WITH {_BLOCKS} SELECT page, arg_min(text, block_id) AS code FROM b WHERE y0 >= 85 AND x0 >= 30 AND regexp_matches(text, '{L.CODE}') GROUP BY page",
}
