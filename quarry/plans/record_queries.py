"""Seeds, stand-ins, matches with guidelines, attached references, turns and lists over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import citations as C
from quarry.operators import conversations as V
from quarry.operators import etl as E
from quarry.operators import knowledge as K
from quarry.operators import ranking as R
from quarry.operators import resolution as P
from quarry.operators import search as S
from quarry.plans import conversation_queries as T
from quarry.plans import resolution_queries as Q
from quarry.plans.graph_queries import _seeds
from quarry.plans.search_queries import _bm25, questions, table

RULES = [(("therapy", "that"), "RULE-1"), (("eau", "und"), "RULE-2")]


def _hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = S.bm25_search(docs, questions(spark, sf_dir), 6)
    return hits.join(docs.select("doc_id", "text", "lang", "source"), "doc_id")


def seed_pages(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 3 == 0, "discussion").otherwise("clinical_guideline")
    code = F.concat_ws("-", F.when(F.col("doc_id") % 2 == 0, F.lit("A1")).otherwise(F.upper("lang")), F.col("doc_id") % 50)
    hits = _hits(spark, sf_dir).select("query_id", "rank", kind.alias("page_type"), code.alias("code"))
    return P.seed_pages(questions(spark, sf_dir), hits, RULES)


def source_triples(spark, sf_dir):
    hits = _hits(spark, sf_dir).select("query_id", "rank", F.concat(F.lit("d"), "doc_id").alias("source_id"), F.when(F.col("doc_id") % 2 == 0, F.concat_ws("-", "lang", "rank")).alias("code"), "text")
    seeds = Q.seed_candidates(spark, sf_dir).filter("query_id % 2 = 0")
    rows = P.source_triples(hits, seeds, 3)
    return rows.select("query_id", "triple_id", "subject_name", "object_name", "score", F.md5("evidence_text").alias("evidence"))


def node_focus(spark, sf_dir):
    edges, _ = Q._edges(spark, sf_dir)
    return P.node_focus(edges, _seeds(spark, sf_dir))


def placed_tables(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    lines = docs.select(F.col("doc_id").alias("query_id"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    lines = lines.withColumn("text", F.concat("text", F.lit(" [S"), (F.col("query_id") + F.col("at")) % 5, F.lit("]")))
    tables = docs.select(F.col("doc_id").alias("query_id"), F.explode(F.array(F.lit(1), F.lit(3), F.lit(9))).alias("number"))
    return C.place_tables(lines, tables)


def chunk_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return E.chunk_counts(docs.select(F.col("source").alias("article_id"), F.when(F.col("text").contains(" | "), "table").when(F.col("doc_id") % 2 == 0, "text").alias("content_type")))


def shared_paths(spark, sf_dir):
    rows = T.tree(spark, sf_dir)
    shares = rows.filter("id = 0 and conv_id % 3 = 0").select(F.concat(F.lit("token-"), "conv_id").alias("token"), "conv_id")
    return V.shared_paths(shares, rows)


def conversation_list(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    conversations = rows.groupBy("conv_id").agg(F.max(F.length("text")).alias("updated_at")).withColumn("user_id", F.col("conv_id") % 7)
    return V.conversation_list(conversations, rows).select("user_id", "conv_id", "updated_at", "n_messages", "place")


def appended_turns(spark, sf_dir):
    """Every conversation gets two more answers to its first message."""
    rows = T.tree(spark, sf_dir).select("conv_id", "id", "pos", "parent_id", "active_child_id")
    more = rows.filter("id = 0").select("conv_id", F.explode(F.array(F.lit(1000), F.lit(1001))).alias("id"))
    kinds = dict(rows.dtypes)
    more = more.select("conv_id", F.col("id").cast(kinds["id"]).alias("id"), F.col("id").cast(kinds["pos"]).alias("pos"), F.lit(0).cast(kinds["parent_id"]).alias("parent_id"))
    return V.append_turns(rows, more).select("conv_id", "id", "parent_id", "active_child_id")


def _works(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select(
        F.col("doc_id").alias("pos"), F.col("source"), F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" "), F.col("doc_id") % 200)).alias("pmid"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("https://doi.org/10.1/A"), F.col("doc_id") % 90, F.lit("."))).alias("doi"),
    )


def guideline_matches(spark, sf_dir):
    works = _works(spark, sf_dir)
    index = R.guideline_index(works.filter("pos % 2 = 0"))
    return R.cited_in_guideline(works, index).select("pos", "guideline_by", F.md5("guideline_label").alias("label"))


def attached_references(spark, sf_dir):
    """Documents with a number in brackets are links of a question (by language and source) to a reference."""
    docs = table(spark, sf_dir, "documents")
    links = docs.select(F.concat_ws("-", "lang", "source").alias("query_id"), F.col("doc_id").alias("source_id"), (F.col("doc_id") % 20).alias("ref_number"), F.col("lang").alias("article_id"))
    answers = docs.groupBy(F.concat_ws("-", "lang", "source").alias("query_id")).agg(F.max(F.when(F.col("doc_id") % 3 == 0, "said [S1]").otherwise("nothing")).alias("answer"))
    return C.keep_attached(links, links.filter("source_id % 11 = 0").select("query_id", "source_id"), answers).select("query_id", "source_id", "ref_number")


def flow_triples(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    links = customer.select(
        F.concat(F.lit("page-"), "c_nationkey").alias("page_id"), F.when(F.col("c_nationkey") > 0, F.concat(F.lit("N-"), "c_nationkey")).alias("source_code"), F.when(F.col("c_custkey") % 5 > 0, F.concat(F.lit("C-"), "c_custkey")).alias("target_code"),
        F.when(F.col("c_custkey") % 2 == 0, F.col("c_mktsegment")).alias("anchor"), F.when(F.col("c_custkey") % 7 == 0, "navigation").otherwise("flow").alias("kind"), F.col("c_name").alias("text"),
    )
    return K.link_triples(links).select("subject_id", "relation", "object_id", "evidence_text", F.array_join("evidence_source_ids", ",").alias("sources"), "confidence")


def repaired_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(X.plain_spaces("text")).alias("plain"), X.is_noise_label(F.split_part("text", F.lit(" "), F.lit(1))).alias("noise"), X.is_safe_image(F.concat(F.split_part("text", F.lit(" "), F.lit(1)), F.lit(".png"))).alias("safe"))


QUERIES = {
    "seed_pages": seed_pages,
    "source_triples": source_triples,
    "node_focus": node_focus,
    "placed_tables": placed_tables,
    "chunk_counts": chunk_counts,
    "shared_paths": shared_paths,
    "conversation_list": conversation_list,
    "appended_turns": appended_turns,
    "guideline_matches": guideline_matches,
    "attached_references": attached_references,
    "flow_triples": flow_triples,
    "repaired_texts": repaired_texts,
}

_PATH = T.ORACLE_SQL["tree_active_path"]

ORACLE_SQL = {
    "seed_pages": f"""
WITH {_bm25(6)},
x AS (
  SELECT query_id, CASE WHEN doc_id % 2 = 0 THEN 'A1' ELSE upper(documents.lang) END || '-' || doc_id % 50 AS code, rank FROM h JOIN documents USING (doc_id) WHERE doc_id % 3 <> 0),
b AS (SELECT query_id, arg_min(code, rank) AS best FROM x WHERE regexp_matches(code, '^[A-Z]+-[0-9]+$') GROUP BY query_id),
i AS (
  SELECT item_id AS query_id, CASE WHEN contains(lower(text), 'therapy') OR contains(lower(text), 'that') THEN 'RULE-1' WHEN contains(lower(text), 'eau') OR contains(lower(text), 'und') THEN 'RULE-2' END AS intent FROM benchmark)
SELECT query_id, coalesce(intent, best) AS seed, CASE WHEN intent IS NOT NULL THEN 'intent_map' WHEN best IS NOT NULL THEN 'hit_fallback' ELSE 'none' END AS origin FROM i LEFT JOIN b USING (query_id)""",
    "source_triples": f"""
WITH {_bm25(6)},
x AS (
  SELECT query_id, rank, CASE WHEN doc_id % 2 = 0 THEN documents.lang || '-' || rank ELSE 'd' || doc_id END AS name, documents.text AS ev FROM h JOIN documents USING (doc_id)),
k AS (SELECT query_id, item FROM ({Q.ORACLE_SQL['seed_candidates']}) WHERE position = 1 AND query_id % 2 = 0),
n AS (
  SELECT x.query_id, x.rank, x.name, x.ev, coalesce(k.item, o.name) AS subject FROM x LEFT JOIN k ON x.query_id = k.query_id LEFT JOIN (SELECT query_id, name FROM x WHERE rank = 1) o ON x.query_id = o.query_id WHERE x.rank <= 3)
SELECT query_id, concat_ws(':', 'synth', rank, subject, name) AS triple_id, subject AS subject_name, name AS object_name, round(0.58 + 0.03 * rank, 6)::DOUBLE AS score, md5(substr(ev, 1, 240)) AS evidence FROM n""",
    "node_focus": """
WITH e AS (
  SELECT 's' || s_suppkey AS source, CASE WHEN s_suppkey % 2 = 0 THEN 'EDGE' ELSE 'SUPPLIES' END AS relation, 'n' || s_nationkey AS target FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'IN', 'r' || n_regionkey FROM nation)
SELECT DISTINCT CAST(r_regionkey AS BIGINT) AS query_id, e.* FROM e JOIN region ON 'r' || r_regionkey = source OR 'r' || r_regionkey = target""",
    "placed_tables": r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM documents),
m AS (SELECT doc_id, i, CAST(unnest(regexp_extract_all(line || ' [S' || (doc_id + i) % 5 || ']', '(?i)\[S(\d+)\]', 1)) AS INT) AS number FROM l),
f AS (SELECT doc_id, number, min(i) AS i FROM m GROUP BY ALL)
SELECT d.doc_id AS query_id, n.number, CAST(f.i AS INT) AS "at" FROM documents d CROSS JOIN (SELECT unnest([1, 3, 9]) AS number) n LEFT JOIN f ON f.doc_id = d.doc_id AND f.number = n.number""",
    "chunk_counts": "SELECT source AS article_id, count(*) AS chunks, count(*) FILTER (contains(text, ' | ')) AS tables FROM documents GROUP BY source",
    "shared_paths": f"SELECT 'token-' || conv_id AS token, conv_id, depth, id FROM ({_PATH}) WHERE conv_id % 3 = 0",
    "conversation_list": """
WITH c AS (SELECT conv_id, max(length(text)) AS updated_at, count(*) AS n_messages, conv_id % 7 AS user_id FROM conversations GROUP BY conv_id)
SELECT user_id, conv_id, updated_at, n_messages, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, conv_id) AS place FROM c""",
    "appended_turns": f"""
WITH {T._TREE}
SELECT conv_id, id, parent_id, CASE WHEN id = 0 THEN 1001 ELSE active_child_id END AS active_child_id FROM t
UNION ALL SELECT conv_id, unnest([1000, 1001]), 0, NULL FROM t WHERE id = 0""",
    "guideline_matches": r"""
WITH w AS (
  SELECT doc_id AS pos, source, split_part(text, chr(10), 1) AS title, CASE WHEN doc_id % 4 = 0 THEN CAST(doc_id % 200 AS VARCHAR) END AS pmid, CASE WHEN doc_id % 3 = 0 THEN '10.1/a' || doc_id % 90 END AS doi,
    substr(trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9一-鿿]+', ' ', 'g'), ' '), 1, 160) AS tkey FROM documents),
p AS (SELECT pmid, arg_min(title, pos) AS label FROM w WHERE pos % 2 = 0 AND pmid IS NOT NULL GROUP BY pmid),
d AS (SELECT doi, arg_min(title, pos) AS label FROM w WHERE pos % 2 = 0 AND doi IS NOT NULL GROUP BY doi),
t AS (SELECT tkey, arg_min(title, pos) AS label FROM w WHERE pos % 2 = 0 AND tkey <> '' GROUP BY tkey)
SELECT pos, CASE WHEN p.label IS NOT NULL THEN 'pmid' WHEN d.label IS NOT NULL THEN 'doi' WHEN t.label IS NOT NULL THEN 'title' END AS guideline_by, md5(coalesce(p.label, d.label, t.label)) AS label
FROM w LEFT JOIN p USING (pmid) LEFT JOIN d USING (doi) LEFT JOIN t USING (tkey)""",
    "attached_references": """
WITH l AS (SELECT lang || '-' || source AS query_id, doc_id AS source_id, doc_id % 20 AS ref_number FROM documents),
m AS (SELECT query_id FROM l GROUP BY query_id HAVING bool_or(source_id % 3 = 0))
SELECT * FROM l WHERE (query_id, ref_number) IN (SELECT (query_id, ref_number) FROM l WHERE source_id % 11 = 0 AND query_id IN (SELECT query_id FROM m))""",
    "flow_triples": """
SELECT coalesce(CASE WHEN c_nationkey > 0 THEN 'N-' || c_nationkey END, 'page-' || c_nationkey) AS subject_id, 'NEXT_STEP' AS relation, 'C-' || c_custkey AS object_id,
  CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE c_name END AS evidence_text, 'page-' || c_nationkey AS sources, 0.97::DOUBLE AS confidence
FROM customer WHERE c_custkey % 7 <> 0 AND c_custkey % 5 > 0""",
    "repaired_texts": r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(replace(translate(coalesce(text, ''), '‐‑–', '---'), chr(173), ''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS plain,
  regexp_matches(trim(coalesce(split_part(text, ' ', 1), ''), ' '), '(?i)^(\d*|\[\d+\]|(node|edge|entity|item|page|triple)[:_-]?\d*)$') AS noise,
  coalesce(NOT contains(split_part(text, ' ', 1) || '.png', '..') AND NOT regexp_matches(split_part(text, ' ', 1), '[/\\\x00-\x1f]'), false) AS safe FROM documents""",
}
