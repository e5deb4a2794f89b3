"""Concept graphs over ``orders``, figures and traces of answers over ``documents`` and ``benchmark``, word grids over ``lineitem``, levels over ``part``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions.text import capitals
from quarry.operators import chapters as H
from quarry.operators import concepts as K
from quarry.operators import figures as I
from quarry.operators import grids as W
from quarry.operators import molecular as M
from quarry.operators import search as S
from quarry.operators import traces as T
from quarry.plans.evidence_queries import _SENT
from quarry.plans.search_queries import _bm25, questions, table


def _customer(key):
    """Two spellings of a label, of which each pair of customers has one."""
    return F.concat(F.when(key % 2 == 0, "Customer#").otherwise("customer "), F.floor(key / 2))


def _reified(spark, sf_dir):
    """Orders are triple nodes from their customer to another; the ends are told by edges, ids or names."""
    customer, nation, orders = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    c, o = F.col("c_custkey"), F.col("o_orderkey")
    node = lambda key: F.concat(F.lit("c"), key)
    other = o * 7 % 1000
    nodes = customer.select(node(c).alias("node"), F.lit("Customer").alias("kind"), _customer(c).alias("label"))
    nodes = nodes.unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("node"), F.lit("Nation").alias("kind"), F.col("n_name").alias("label")))
    triples = orders.select(
        F.concat(F.lit("o"), o).alias("node"),
        F.lit("TrustedTriple").alias("kind"),
        F.lit("order").alias("label"),
        F.when(o % 10 > 0, F.col("o_orderpriority")).alias("relation"),
        F.when(o % 3 == 1, node(F.col("o_custkey"))).alias("subject_id"),
        F.when(o % 3 == 2, _customer(F.col("o_custkey"))).alias("subject_name"),
        F.when(o % 4 == 1, node(other)).when(o % 4 == 3, F.concat(F.lit("x"), o)).alias("object_id"),
        F.when(o % 4 == 2, _customer(other)).when(o % 4 == 3, F.concat(F.lit("Group "), o % 50)).alias("object_name"),
    )
    edges = orders.filter(o % 3 == 0).select(node(F.col("o_custkey")).alias("source"), F.lit("SUBJECT_OF").alias("relation"), F.concat(F.lit("o"), o).alias("target"))
    edges = edges.unionByName(orders.filter(o % 4 == 0).select(F.concat(F.lit("o"), o).alias("source"), F.lit("OBJECT_OF").alias("relation"), node(other).alias("target")))
    lives = F.when(c % 2 == 0, "edge").otherwise("lives in")
    edges = edges.unionByName(customer.select(node(c).alias("source"), lives.alias("relation"), F.concat(F.lit("n"), "c_nationkey").alias("target")))
    return nodes.unionByName(triples, allowMissingColumns=True), edges


def concept_edges(spark, sf_dir):
    return K.concept_edges(*_reified(spark, sf_dir))


def _centers(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("customer"), "s_suppkey").alias("concept"))


def concept_views(spark, sf_dir):
    return K.concept_view(concept_edges(spark, sf_dir), _centers(spark, sf_dir))


def _figures(spark, sf_dir):
    """Each hit has a page and a figure; figures of every third question are of pages that no hit has."""
    hits = S.bm25_search(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 6).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    hits = hits.select("query_id", "rank", F.concat_ws("-", F.upper("lang"), F.col("doc_id") % 5).alias("page_code"), (F.col("doc_id") % 7).alias("pdf_page"))
    q, r = F.col("query_id"), F.col("rank")
    figures = hits.select(
        "query_id",
        F.concat(F.lit("f"), r).alias("figure"),
        (7 - r).alias("place"),
        F.when((q % 3 == 0) & (r > 1), F.concat(F.lit("fx-"), r)).otherwise(F.lower("page_code")).alias("page_code"),
        F.when(r % 3 == 0, F.col("pdf_page") + 1).otherwise(F.col("pdf_page")).alias("pdf_page"),
        F.when(r % 2 == 0, r).alias("source_index"),
    )
    said = F.concat(F.lit("see [S"), q % 9 + 1, F.lit("] and EN-"), q % 5, F.lit(" or fx-"), q % 4 + 2)
    answers = questions(spark, sf_dir).select("query_id", F.when(q % 5 == 0, "nothing").when(q % 5 == 1, F.concat(F.lit("only [S"), q % 7, F.lit("]"))).otherwise(said).alias("answer"), F.concat(F.lit("fr-"), q % 3).alias("seed_code"))
    return figures, hits, answers


def figure_sources(spark, sf_dir):
    figures, hits, _ = _figures(spark, sf_dir)
    return I.with_source_index(figures, hits).select("query_id", "figure", "source_index")


def shown_figures(spark, sf_dir):
    return I.shown_figures(*_figures(spark, sf_dir), most=3)


def _words(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("page"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("word_id"))
    rows = rows.agg(F.max("l_quantity").alias("q"), F.max("l_returnflag").alias("f"), F.max("l_linenumber").alias("n"), F.max("l_orderkey").alias("o"))
    label = F.concat("f", "n")
    return rows.select("page", "word_id", (F.floor(F.col("q") / 10) * 100 + F.col("n") * 2).cast("double").alias("x0"), (F.col("o") % 12 * 20 + F.col("n")).cast("double").alias("y0"), F.when(F.col("f") == "A", F.concat(F.lit("["), label, F.lit("]"))).otherwise(label).alias("text"))


def word_grids(spark, sf_dir):
    grids = W.word_grid(_words(spark, sf_dir))
    drawn = F.array_join(F.transform("grid", lambda r: F.array_join(r, "|")), "\n")
    return grids.select("page", F.size("grid").alias("n_rows"), drawn.alias("cells"), W.is_table(F.col("grid")).alias("is_table"), W.is_reference_grid(F.col("grid")).alias("is_references"))


def reflowed_texts(spark, sf_dir):
    """The first line of each document, as it would be cut from a page."""
    return table(spark, sf_dir, "documents").select("doc_id", W.is_reflow(F.split_part("text", F.lit("\n"), F.lit(1))).alias("reflow"))


def _asked(spark, sf_dir):
    """Each question is searched by its text alone; its scope and the names of it go by its number."""
    q = F.col("query_id")
    articles = F.when(q % 4 > 0, F.array(F.lit("src1"), F.lit("src2")))
    return questions(spark, sf_dir).select("query_id", "query", F.array("query").alias("searches"), articles.alias("articles"), F.when(q % 4 > 1, F.array(F.lit("DE"))).alias("modules"), F.when(q % 4 > 2, F.array(F.lit("src5"))).alias("terms"))


def _found(spark, sf_dir):
    hits = S.bm25_search(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 5)
    return hits.join(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"), "doc_id").withColumnRenamed("doc_id", "source_id")


def evidence_traces(spark, sf_dir):
    rows = T.evidence_trace(_found(spark, sf_dir), _asked(spark, sf_dir))
    return rows.select("query_id", "source_id", "rank", "matched_sentence", "paragraph_index", F.array_join("matched_terms", ",").alias("terms"), F.round("confidence", 6).alias("confidence"))


def _hit_triples(spark, sf_dir):
    """Each hit is a triple from the second word of its text to its source; the last of a question stands in."""
    d = F.col("source_id")
    ids = F.when(d % 3 > 0, F.array(F.concat(F.lit("disc-"), "source", F.lit("-p1-c2")), F.concat(F.lit("page-"), F.upper("lang"), F.lit("-3")))).otherwise(F.array(F.concat(F.lit("page-"), d)))
    return _found(spark, sf_dir).select(
        "query_id",
        "rank",
        F.concat(F.when(F.col("rank") == 5, "synth:").otherwise("t:"), d).alias("triple_id"),
        F.when(d % 7 > 0, F.split_part(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(2))).alias("subject_name"),
        F.lit("MENTIONS").alias("relation"),
        F.col("source").alias("object_name"),
        (F.lit(1.0) / F.col("rank")).alias("confidence"),
        F.when(d % 11 == 0, "fallback").alias("validation_status"),
        F.lit(None).cast("string").alias("review_status"),
        ids.alias("evidence_source_ids"),
    )


def prompt_triples(spark, sf_dir):
    return T.prompt_triples(_hit_triples(spark, sf_dir), _asked(spark, sf_dir)).select("query_id", "rank", "triple_id")


def reasoning_traces(spark, sf_dir):
    kept = T.prompt_triples(_hit_triples(spark, sf_dir), _asked(spark, sf_dir))
    rows = T.reasoning_trace(_asked(spark, sf_dir), _found(spark, sf_dir), kept)
    evidence = F.transform("evidence", lambda e: F.concat_ws(":", e["rank"], e["source_id"], e["paragraph_index"], F.size(e["matched_terms"])))
    steps = F.transform("steps", lambda t: F.concat_ws(":", t["rank"], t["triple_id"]))
    return rows.select("query_id", "question", F.array_join("keywords", ",").alias("keywords"), F.array_join(evidence, ",").alias("evidence"), F.array_join(steps, ",").alias("steps"), "evidence_count", "step_count")


def chapter_labels(spark, sf_dir):
    """Documents of a source are chapters of a book; its contents list the first lines of those in English, in upper case."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), F.col("doc_id").alias("chapter"), "lang", F.split(F.coalesce("text", F.lit("")), "\n").alias("l"))
    chapters = docs.select("doc_id", "chapter", F.slice("l", 1, 3).alias("lines"), F.when(F.col("chapter") % 4 > 0, F.get("l", F.lit(0))).alias("heading"))
    contents = docs.filter("lang = 'en'").select("doc_id", F.col("chapter").alias("at"), capitals(F.get("l", F.lit(0))).alias("title"))
    return H.chapter_labels(chapters, contents, SUBJECTS)


SUBJECTS = (("(?i)tion", "tion", "On tion"), ("(?i)eau", "water", "On eau"))


def framework_levels(spark, sf_dir):
    k = F.col("p_partkey")
    level = F.when(k % 7 > 0, F.concat(F.lit("l"), k % 7))
    kind = F.get(F.array(*map(F.lit, ("Predictive", "prognostic", "germline", "Targeted therapy"))), (k % 5).cast("int"))
    said = F.get(F.array(*map(F.lit, ("Pathogenic", "Likely pathogenic", "benign", "Likely benign", "VUS", "none"))), (k % 8).cast("int"))
    provider = F.when(k % 3 == 0, "civic").otherwise("ClinVar")
    return table(spark, sf_dir, "part").select("p_partkey", M.framework_levels(level, kind, provider, said).alias("f")).select("p_partkey", "f.*")


QUERIES = {
    "evidence_traces": evidence_traces,
    "prompt_triples": prompt_triples,
    "reasoning_traces": reasoning_traces,
    "chapter_labels": chapter_labels,
    "framework_levels": framework_levels,
    "concept_edges": concept_edges,
    "concept_views": concept_views,
    "figure_sources": figure_sources,
    "shown_figures": shown_figures,
    "word_grids": word_grids,
    "reflowed_texts": reflowed_texts,
}

_LABEL = "CASE WHEN {0} % 2 = 0 THEN 'Customer#' ELSE 'customer ' END || ({0} // 2)"
_EDGES = f"""
k AS (SELECT 'c' || c_custkey AS node, 'customer' || (c_custkey // 2) AS key FROM customer UNION ALL SELECT 'n' || n_nationkey, regexp_replace(lower(n_name), '[^a-z0-9]+', '', 'g') FROM nation),
t AS (SELECT o_orderkey AS o, 'c' || o_custkey AS s, 'customer' || (o_custkey // 2) AS sn, 'c' || (o_orderkey * 7 % 1000) AS b, 'customer' || (o_orderkey * 7 % 1000 // 2) AS bn, upper(CASE WHEN o_orderkey % 10 > 0 THEN o_orderpriority ELSE 'order' END) AS relation FROM orders),
e AS (
  SELECT CASE WHEN o % 3 = 2 THEN sn ELSE coalesce(x.key, s) END AS source, relation, CASE o % 4 WHEN 2 THEN bn WHEN 3 THEN 'group' || (o % 50) ELSE coalesce(y.key, b) END AS target
  FROM t LEFT JOIN k x ON x.node = s LEFT JOIN k y ON y.node = b
  UNION ALL SELECT x.key, 'LIVES IN', y.key FROM customer JOIN k x ON x.node = 'c' || c_custkey JOIN k y ON y.node = 'n' || c_nationkey WHERE c_custkey % 2 = 1),
edges AS (SELECT DISTINCT source, relation, target FROM e WHERE source <> target)"""

_FIGURES = f"""{_bm25(6)},
hit AS (SELECT query_id, rank, upper(lang) || '-' || (doc_id % 5) AS code, doc_id % 7 AS pdf FROM h JOIN documents USING (doc_id)),
fig AS (SELECT query_id, 'f' || rank AS figure, 7 - rank AS place, CASE WHEN query_id % 3 = 0 AND rank > 1 THEN 'FX-' || rank ELSE code END AS code, CASE WHEN rank % 3 = 0 THEN pdf + 1 ELSE pdf END AS pdf, CASE WHEN rank % 2 = 0 THEN rank END AS idx FROM hit)"""

_TRACES = f"""{_bm25(5)},
kw AS (SELECT item_id AS query_id, text AS query, list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) > 2)[:8] AS ks FROM benchmark),
fd AS (SELECT query_id, doc_id AS source_id, rank, score, text, lang, source, ks, query FROM h JOIN documents USING (doc_id) JOIN kw USING (query_id)),
sn AS (SELECT query_id, source_id, unnest({_SENT}) AS s, generate_subscripts({_SENT}, 1) AS i, ks FROM fd),
bs AS (SELECT query_id, source_id, arg_max(s, len(list_filter(ks, lambda k: contains(lower(s), lower(k)))) * 1000000 - i) AS s FROM sn GROUP BY ALL),
ev AS (
  SELECT query_id, source_id, rank, substr(coalesce(s, ''), 1, 260) AS said, list_filter(ks, lambda k: contains(lower(text), lower(k))) AS ts, score,
    list_filter(regexp_split_to_array(text, '\\n{{2,}}'), lambda p: regexp_matches(p, '\\S')) AS ps FROM fd LEFT JOIN bs USING (query_id, source_id)),
tr AS (
  SELECT query_id, source_id, rank, greatest(coalesce(list_position(list_transform(ps, lambda p: said <> '' AND contains(p, said)), true), 0) - 1, 0) AS para, said, ts, score FROM ev),
pt AS (
  SELECT query_id, rank, 't:' || source_id AS triple_id, split_part(text, ' ', 2) AS subject, source, lang, source_id, query FROM fd
  WHERE rank < 5 AND source_id % 7 > 0 AND source_id % 11 > 0 AND trim(split_part(text, ' ', 2)) <> '' AND trim(source) <> ''),
ok AS (
  SELECT query_id, rank, triple_id FROM pt WHERE CASE WHEN query_id % 4 = 0 THEN true
    WHEN source_id % 3 > 0 THEN source IN ('src1', 'src2') OR (query_id % 4 > 1 AND upper(lang) = 'DE')
    ELSE (query_id % 4 > 2 AND contains(lower(subject || ' ' || source), 'src5'))
      OR len(list_filter(regexp_split_to_array(lower(subject || ' ' || source), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 3 AND contains(lower(query), x))) > 0 END)"""

ORACLE_SQL = {
    "evidence_traces": f"WITH {_TRACES} SELECT query_id, source_id, rank, said AS matched_sentence, CAST(para AS INT) AS paragraph_index, array_to_string(ts, ',') AS terms, round(score, 6) AS confidence FROM tr",
    "prompt_triples": f"WITH {_TRACES} SELECT * FROM ok",
    "reasoning_traces": f"""
WITH {_TRACES},
ea AS (SELECT query_id, string_agg(concat_ws(':', rank, source_id, para, len(ts)), ',' ORDER BY rank) AS evidence, count(*) AS n FROM tr GROUP BY query_id),
sa AS (SELECT query_id, string_agg(rank || ':' || triple_id, ',' ORDER BY rank) AS steps, count(*) AS m FROM ok GROUP BY query_id)
SELECT query_id, query AS question, array_to_string(ks, ',') AS keywords, coalesce(evidence, '') AS evidence, coalesce(steps, '') AS steps, CAST(coalesce(n, 0) AS INT) AS evidence_count, CAST(coalesce(m, 0) AS INT) AS step_count
FROM kw LEFT JOIN ea USING (query_id) LEFT JOIN sa USING (query_id)""",
    "chapter_labels": r"""
WITH d AS (SELECT source AS doc_id, doc_id AS chapter, lang, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
c AS (SELECT doc_id, trim(regexp_replace(lower(l[1]), '\s+', ' ', 'g')) AS key, arg_min(upper(l[1]), chapter) AS known FROM d WHERE lang = 'en' GROUP BY ALL HAVING key <> ''),
x AS (SELECT doc_id, chapter, unnest(l[:3]) AS line, generate_subscripts(l[:3], 1) AS i FROM d),
t AS (SELECT x.doc_id, chapter, arg_min(known, i) AS known FROM x JOIN c ON x.doc_id = c.doc_id AND c.key = trim(regexp_replace(lower(line), '\s+', ' ', 'g')) GROUP BY ALL),
n AS (SELECT d.doc_id, d.chapter, known, nullif(trim(CASE WHEN d.chapter % 4 > 0 THEN l[1] ELSE '' END), '') AS heading FROM d LEFT JOIN t ON d.doc_id = t.doc_id AND d.chapter = t.chapter),
m AS (SELECT *, coalesce(known, heading) AS name FROM n)
SELECT doc_id, chapter,
  CASE WHEN name IS NULL THEN 'general' WHEN regexp_matches(name, '(?i)tion') THEN 'tion' WHEN regexp_matches(name, '(?i)eau') THEN 'water' ELSE coalesce(nullif(trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'general') END AS article_id,
  CASE WHEN name IS NULL THEN 'General' WHEN regexp_matches(name, '(?i)tion') THEN 'On tion' WHEN regexp_matches(name, '(?i)eau') THEN 'On eau' ELSE name END AS title,
  CASE WHEN known IS NOT NULL THEN 'contents' WHEN heading IS NOT NULL THEN 'heading' ELSE 'default' END AS told_by FROM m""",
    "framework_levels": """
WITH x AS (SELECT p_partkey, p_partkey % 7 AS l, ['predictive', 'prognostic', 'germline', 'targeted therapy'][p_partkey % 5 + 1] AS kind, ['P', 'LP', 'B', 'LB', 'VUS'][p_partkey % 8 + 1] AS c FROM part)
SELECT p_partkey, 'Tier ' || CASE l WHEN 1 THEN 'I' WHEN 2 THEN 'I/II' WHEN 3 THEN 'II' WHEN 4 THEN 'III' ELSE 'IV' END AS amp,
  CASE WHEN kind IN ('predictive', 'targeted therapy') THEN CASE l WHEN 1 THEN 'I-A' WHEN 2 THEN 'I-B' WHEN 3 THEN 'II-B' WHEN 4 THEN 'III-A' ELSE 'V' END WHEN kind = 'prognostic' THEN CASE WHEN l BETWEEN 1 AND 3 THEN 'IV' ELSE 'V' END END AS escat,
  CASE WHEN kind = 'germline' AND p_partkey % 3 > 0 THEN c END AS acmg FROM x""",
    "concept_edges": f"WITH {_EDGES} SELECT * FROM edges",
    "concept_views": f"""
WITH RECURSIVE {_EDGES},
ways AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
w AS (
  SELECT s_suppkey AS query_id, ['customer' || s_suppkey] AS kept, ['customer' || s_suppkey] AS front, 0 AS depth FROM supplier
  UNION ALL
  SELECT query_id, list_concat(kept, fresh), fresh, depth + 1 FROM (
    SELECT query_id, kept, depth, list(b ORDER BY p, b)[:18 - len(kept)] AS fresh FROM (
      SELECT query_id, kept, depth, b, min(p) AS p FROM (SELECT query_id, kept, depth, unnest(front) AS f, generate_subscripts(front, 1) AS p FROM w) JOIN ways ON a = f WHERE NOT list_contains(kept, b) GROUP BY ALL)
    GROUP BY query_id, kept, depth)
  WHERE len(fresh) > 0),
n AS (SELECT query_id, depth, unnest(front) AS concept, len(kept) - len(front) + generate_subscripts(front, 1) AS position FROM w)
SELECT query_id, concept, depth, CAST(position AS INT) AS position FROM n""",
    "figure_sources": f"""
WITH {_FIGURES}
SELECT f.query_id, figure, coalesce(idx, (SELECT max(rank) FROM hit x WHERE x.query_id = f.query_id AND x.code = f.code), (SELECT max(rank) FROM hit x WHERE x.query_id = f.query_id AND x.pdf = f.pdf)) AS source_index FROM fig f""",
    "shown_figures": f"""
WITH {_FIGURES},
said AS (
  SELECT item_id AS query_id, CASE item_id % 5 WHEN 0 THEN [] WHEN 1 THEN [item_id % 7] ELSE [item_id % 9 + 1] END AS cited,
    CASE WHEN item_id % 5 < 2 THEN [] ELSE ['EN-' || (item_id % 5), 'FX-' || (item_id % 4 + 2)] END AS named, 'FR-' || (item_id % 3) AS seed FROM benchmark),
met AS (
  SELECT f.query_id, figure, bool_or(x.code = f.code) AS of_hit, bool_or(x.rank = idx AND list_contains(named, x.code)) AS hit_named, min(x.rank) FILTER (list_contains(cited, x.rank)) AS hit
  FROM fig f JOIN said USING (query_id) JOIN hit x ON x.query_id = f.query_id AND (x.rank = idx OR x.code = f.code OR x.pdf = f.pdf) GROUP BY ALL),
tiered AS (
  SELECT f.*, hit, code = seed AS own, CASE WHEN list_contains(cited, idx) THEN 0 WHEN list_contains(named, code) THEN CASE WHEN of_hit THEN 0 ELSE 1 END WHEN hit_named THEN 0 WHEN hit IS NOT NULL THEN 2 WHEN code = seed THEN 3 ELSE 4 END AS tier
  FROM fig f JOIN said USING (query_id) LEFT JOIN met ON met.query_id = f.query_id AND met.figure = f.figure),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, CASE WHEN tier = 2 THEN hit END, place) AS n, min(tier) OVER (PARTITION BY query_id) AS best FROM tiered),
firsts AS (SELECT * FROM ranked WHERE CASE WHEN best <= 1 THEN tier <= 1 AND n <= 3 ELSE n = 1 END),
beside AS (
  SELECT query_id, arg_min(figure, place) AS figure, 5 AS tier, (SELECT count(*) + 1 FROM firsts s WHERE s.query_id = o.query_id) AS n FROM ranked o
  WHERE own AND NOT EXISTS (SELECT 1 FROM firsts s WHERE s.query_id = o.query_id AND s.own) GROUP BY query_id HAVING n <= 3)
SELECT query_id, figure, ['cited', 'page', 'hit', 'seed', 'first', 'beside'][tier + 1] AS tier, CAST(n AS INT) AS position FROM (SELECT query_id, figure, tier, n FROM firsts UNION ALL SELECT * FROM beside)""",
    "word_grids": r"""
WITH g AS (SELECT l_partkey AS page, l_orderkey * 10 + l_linenumber AS word_id, max(l_quantity) AS q, max(l_returnflag) AS f, max(l_linenumber) AS n, max(l_orderkey) AS o FROM lineitem GROUP BY ALL),
w AS (SELECT page, word_id, floor(q / 10) * 100 + n * 2 AS x, o % 12 AS band, CASE WHEN f = 'A' THEN '[' || f || n || ']' ELSE f || n END AS t FROM g),
c AS (SELECT page, floor(x / 100) AS k, avg(x) AS m FROM w GROUP BY ALL),
p AS (SELECT page, list(m ORDER BY m) AS ms FROM c GROUP BY page HAVING len(ms) >= 2),
big AS (SELECT page FROM w GROUP BY page HAVING count(*) >= 8),
d AS (SELECT page, word_id, x, band, t, list_position(ms, arg_min(m, abs(x - m))) AS col, len(ms) AS width FROM w JOIN p USING (page) JOIN big USING (page) JOIN c USING (page) GROUP BY page, word_id, x, band, t, ms),
cells AS (SELECT page, band, width, col, string_agg(t, ' ' ORDER BY x, word_id) AS cell FROM d GROUP BY ALL),
rows_ AS (SELECT page, band, map_from_entries(list((col, cell))) AS mm, any_value(width) AS width FROM cells GROUP BY page, band),
lines AS (SELECT page, band, list_transform(range(1, width + 1), lambda i: coalesce(mm[i], '')) AS line FROM rows_)
SELECT page, CAST(count(*) AS INT) AS n_rows, string_agg(array_to_string(line, '|'), chr(10) ORDER BY band) AS cells,
  count(*) >= 2 AND (count(*) FILTER (starts_with(line[1], '[')) >= 2 OR count(*) FILTER (len(list_filter(line, lambda v: v <> '')) >= 2) >= 2) AS is_table, false AS is_references
FROM lines GROUP BY page""",
    "reflowed_texts": r"""
WITH x AS (SELECT doc_id, trim(split_part(coalesce(text, ''), chr(10), 1)) AS t FROM documents)
SELECT doc_id, t = '' OR (regexp_matches(t, '级推荐|分层|分组|Ⅱ级|Ⅲ级|I级') AND len(regexp_extract_all(t, '[。！？]')) <= 1) OR (NOT regexp_matches(t, '[。！？]') AND length(t) < 400) AS reflow FROM x""",
}
