"""Citations, verification and ranking over ``documents``, ``labels`` and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import citations as N
from quarry.functions import text as X
from quarry.operators import citations as C
from quarry.operators import ranking as R
from quarry.operators import search as S
from quarry.plans.search_queries import _bm25, questions, table


def _numbers(f):
    def query(spark, sf_dir):
        return table(spark, sf_dir, "documents").select("doc_id", F.array_join(f(F.col("text")), ",").alias("refs"))

    return query


def _entries(spark, sf_dir):
    """References: number n of a source is its first document with that number."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy(F.col("source").alias("article_id"), (F.col("doc_id") % 250).cast("int").alias("ref_number")).agg(F.min("doc_id").alias("entry_id"))


def resolved_references(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = docs.filter(F.size(N.resolver_refs(F.col("text"))) > 0).select(
        F.col("lang").alias("query_id"), F.col("doc_id").alias("rank"), F.col("doc_id").alias("source_id"), F.col("source").alias("article_id"), "text",
        F.array(*[F.lit(f"{a}{n}") for a in ".,[" for n in range(10)]).alias("keywords"), F.sequence(F.lit(1), F.lit(200)).alias("reference_ids"),
    )
    return C.resolve_references(hits, _entries(spark, sf_dir)).select("query_id", "source_id", "ref_number", "entry_id", "place")


def _answers(spark, sf_dir):
    """An answer for each question, with marks that its hits decide."""
    asked = questions(spark, sf_dir)
    a, b = F.col("query_id") % 7, F.col("query_id") % 4 + 2
    text = F.concat(F.substring("query", 1, 20), F.lit(" [S"), a.cast("string"), F.lit("] , "), F.substring("query", 21, 1 << 30), F.lit(" [s"), b.cast("string"), F.lit("][S99] ."))
    return asked.withColumn("answer", F.when(F.col("query_id") % 5 == 0, F.col("query")).otherwise(text))


def kept_citations(spark, sf_dir):
    hits = S.bm25_search(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 6).withColumnRenamed("doc_id", "source_id")
    return C.keep_cited(_answers(spark, sf_dir).select("query_id", "answer"), hits).select("query_id", "source_id", "rank", "new_rank", "new_answer")


def verified_answers(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    hits = S.bm25_search(docs, questions(spark, sf_dir), 2)
    texts = hits.join(docs.select("doc_id", "text"), "doc_id").groupBy("query_id").agg(F.count("*").alias("n_hits"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n").alias("evidence"))
    rows = _answers(spark, sf_dir).join(texts, "query_id", "left").fillna(0, ["n_hits"])
    rows = rows.withColumns({"entities": X.search_terms("query"), "n_figures": F.lit(0), "kind": F.when(F.col("query_id") % 11 == 3, "chitchat").otherwise("guideline")})
    out = C.verify_answers(rows)
    return out.select("query_id", "citation_count", "raw_citation_count", F.array_join("uncovered", ",").alias("uncovered"), F.array_join("issues", ",").alias("issues"), "ok")


def lexical_overlaps(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    wanted = X.token_set(F.lit("the and of that de la und der"))
    return docs.select("doc_id", F.round(X.overlap(wanted, X.token_set("text")), 6).alias("overlap"))


def best_sentences(spark, sf_dir):
    keys = F.array(F.lit("the"), F.lit("that"), F.lit("un"), F.lit("die"))
    return table(spark, sf_dir, "documents").select("doc_id", C.best_sentence(F.col("text"), keys).alias("sentence"))


def sentence_windows(spark, sf_dir):
    keys = F.array(F.lit("the"), F.lit("that"), F.lit("un"), F.lit("die"))
    return C.sentence_windows(table(spark, sf_dir, "documents"), F.col("text"), keys).select("doc_id", "sentence", "window")


CONCEPTS = R.Concepts(terms=("the", "and", "than", "ou"), biomarkers=("than-d",), interventions=("erin",), target_mesh=("en",), target_terms=("theat", "under"), competing=(("heit",), ("ción",)), lines=(("onre",), ("pation",)))
NOW = 2026


def articles(spark, sf_dir):
    """Documents as articles: the first line is the title, the source the journal."""
    docs = table(spark, sf_dir, "documents")
    kinds = F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("Review"))).when(F.col("doc_id") % 7 == 1, F.array(F.lit("Clinical Trial, Phase II"))).when(F.col("doc_id") % 7 == 2, F.array(F.lit("Editorial"))).otherwise(F.array(F.lit("Journal Article")))
    return docs.select(
        F.col("lang").alias("query_id"),
        F.col("doc_id").alias("pmid"),
        F.col("doc_id").alias("place"),
        F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
        F.expr("substring(text, length(split_part(text, '\n', 1)) + 2)").alias("abstract"),
        kinds.alias("pub_types"),
        F.array("lang").alias("mesh"),
        F.array(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("none")).alias("mesh_major"),
        F.when(F.col("lang") == "en", "eng").otherwise(F.col("lang")).alias("language"),
        (F.lit(2000) + F.col("doc_id") % 27).cast("string").alias("year"),
        F.element_at(F.array(*map(F.lit, ("T0", "T1", "T2G", "T2", "T3", "none"))), (F.col("doc_id") % 6 + 1).cast("int")).alias("journal_tier"),
        (F.col("doc_id") % 13 == 0).alias("in_guideline"),
    )


def literature_ranking(spark, sf_dir):
    ranked = R.rank_articles(articles(spark, sf_dir), CONCEPTS, NOW, top_k=50)
    return ranked.select("query_id", "pmid", "tier", "population", "relevance", "recency", F.round("penalty", 6).alias("penalty"), "score", "rank")


def evidence_tiers(spark, sf_dir):
    rows = articles(spark, sf_dir)
    return rows.groupBy(R.evidence_tier(F.col("title"), F.col("abstract"), F.col("pub_types"), F.col("in_guideline")).alias("tier")).agg(F.count("*").alias("n"))


def journal_lookup(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    journals = parts.select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("full_name"), F.col("p_brand").alias("iso_abbr"), F.array("p_type").alias("aliases"), F.col("p_brand").alias("tier"))
    rows = parts.select(F.col("p_partkey").alias("pmid"), F.concat(F.lit("The "), F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat("p_name", F.lit(" & Co")))).alias("journal"))
    return R.join_journals(rows, R.journal_index(journals)).select("pmid", "journal_pos")


def guideline_citations(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"))
    index = R.guideline_index(docs.select(F.col("doc_id").alias("pos"), F.lit(None).cast("string").alias("pmid"), F.lit(None).cast("string").alias("doi"), "title", "source"))
    return index.select("key", F.array_join("sources", ",").alias("sources"), "label")


def feedback_classes(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select(
        "doc_id", F.col("text").alias("comment"), F.when(F.col("toxic") == 1, "safety").alias("picked"), (F.col("quality") * 5).alias("rating"), F.lit(None).cast("string").alias("helpful")
    )
    out = R.classify_feedback(rows, {"correctness": ("!!", "***"), "evidence": ("[", "reference"), "safety": ("idiot",), "positive": ("than", "les ")})
    return out.select("doc_id", "primary", F.array_join("tags", ",").alias("tags"))


_INLINE = r"[\.,](\d{1,3})(?:-(\d{1,3}))?|[\[\(](\d{1,3})[\]\)]"
_RESOLVE = r"[\.,](\d{1,3})(?:[-–—～~](\d{1,3}))?|[\[\(【](\d{1,3})(?:[-–—～~](\d{1,3}))?[\]\)】]"


def _refs_sql(pattern: str, second: bool, span: int, swap: bool, bound: bool) -> str:
    e1 = f"regexp_extract_all(x, '{pattern}', 2)[i]"
    e = f"coalesce(nullif({e1}, ''), nullif(regexp_extract_all(x, '{pattern}', 4)[i], ''))" if second else f"nullif({e1}, '')"
    first = f"coalesce(nullif(regexp_extract_all(x, '{pattern}', 1)[i], ''), regexp_extract_all(x, '{pattern}', 3)[i])"
    return f"""
p AS (SELECT doc_id, text AS x, unnest(range(1, len(regexp_extract_all(text, '{pattern}')) + 1)) AS i FROM documents),
g AS (SELECT doc_id, CAST({first} AS INT) AS a0, CAST(coalesce({e}, {first}) AS INT) AS b0 FROM p),
o AS (SELECT doc_id, {'least(a0, b0)' if swap else 'a0'} AS a, {'greatest(a0, b0)' if swap else 'b0'} AS b FROM g),
n AS (SELECT DISTINCT doc_id, unnest(range(a, least(b, a + {span - 1}) + 1)) AS n FROM o),
z AS (SELECT doc_id, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS refs FROM n {'WHERE n BETWEEN 1 AND 200' if bound else ''} GROUP BY doc_id)
SELECT d.doc_id, coalesce(refs, '') AS refs FROM documents d LEFT JOIN z USING (doc_id)"""


_ANS = """ans AS (
  SELECT item_id AS query_id, text AS query, CASE WHEN item_id % 5 = 0 THEN text ELSE substr(text, 1, 20) || ' [S' || item_id % 7 || '] , ' || substr(text, 21) || ' [s' || (item_id % 4 + 2) || '][S99] .' END AS answer FROM benchmark)"""
_SENT = r"list_filter(list_transform(regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.。!?！？])\s+', '\1' || chr(10), 'g'), '\n+'), lambda s: trim(s, ' ')), lambda s: s <> '')"

QUERIES = {
    "inline_references": _numbers(N.inline_refs),
    "resolver_references": _numbers(N.resolver_refs),
    "resolved_references": resolved_references,
    "kept_citations": kept_citations,
    "verified_answers": verified_answers,
    "lexical_overlaps": lexical_overlaps,
    "best_sentences": best_sentences,
    "sentence_windows": sentence_windows,
    "literature_ranking": literature_ranking,
    "evidence_tiers": evidence_tiers,
    "journal_lookup": journal_lookup,
    "guideline_citations": guideline_citations,
    "feedback_classes": feedback_classes,
}

_ART = """
a AS (
  SELECT lang AS query_id, doc_id AS pmid, split_part(text, chr(10), 1) AS title, substr(text, length(split_part(text, chr(10), 1)) + 2) AS abstract, lang, doc_id,
    doc_id % 13 = 0 AS g, doc_id % 7 AS k FROM documents)"""
_TIER = r"""
CASE WHEN k IN (0, 2) AND g THEN 'E1' WHEN k IN (0, 2) THEN 'E5' WHEN g OR (regexp_matches(t, '(?i)\bphase\s*(iii|3)\b') AND regexp_matches(t, '(?i)\brandomi[sz]ed\b|\brct\b')) THEN 'E1'
  WHEN (regexp_matches(t, '(?i)\b(ZUMA[-\s]?\d*|JULIET|TRANSCEND|TRANSFORM|BELINDA|EPCORE|POLARIX|GOYA|PHOENIX|ROSEWOOD|LOTIS|STARGLO|ALEXANDER|PILOT|ELARA|CARTITUDE|KARMA)\b')
    OR regexp_matches(t, '(?i)\b(single[- ](arm|center)|open[- ]label|pivotal|registrational|seamless|phase\s*(1b/?2|i/?ii|ib/?ii))\b'))
    AND (k = 1 OR regexp_matches(t, '(?i)\bphase\s*(ii|2|1b/?2|i/?ii|ib/?ii)\b')) THEN 'E2'
  WHEN regexp_matches(t, '(?i)\b(real[- ]world|retrospective|observational|chart review|multicen(?:ter|tre)\s+retrospective)\b') THEN 'E4' ELSE 'E3' END"""
_MUST = "(contains({0}, 'than-d') OR contains(regexp_replace({0}, '[- ]', '', 'g'), 'thand'))", "(contains({0}, 'erin') OR contains(regexp_replace({0}, '[- ]', '', 'g'), 'erin'))"
_BONUS = " + ".join(f"CASE WHEN {m.format('lower(title)')} THEN 0.25 WHEN {m.format('blob')} THEN 0.12 ELSE -0.18 END" for m in _MUST)
_TOK = "list_distinct(list_transform(regexp_extract_all({0}, '[a-zA-Z0-9]+'), lambda t: lower(t)))"
_WANT = "['the', 'and', 'than', 'ou']"

ORACLE_SQL = {
    "inline_references": f"WITH {_refs_sql(_INLINE, False, 20, False, False)}",
    "resolver_references": f"WITH {_refs_sql(_RESOLVE, True, 30, True, True)}",
    "resolved_references": rf"""
WITH k AS (SELECT list_transform(range(30), lambda i: ['.', ',', '['][i // 10 + 1] || i % 10) AS ks),
s AS (SELECT lang, source, doc_id, unnest({_SENT}) AS s, generate_subscripts({_SENT}, 1) AS i FROM documents),
b AS (
  SELECT lang, source, doc_id, s FROM (SELECT s.*, len(list_filter(ks, lambda w: contains(lower(s), w))) AS n FROM s CROSS JOIN k)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) = 1),
p AS (SELECT *, unnest(range(1, len(regexp_extract_all(s, '{_RESOLVE}')) + 1)) AS i FROM b),
g AS (
  SELECT lang, source, doc_id, CAST(coalesce(nullif(regexp_extract_all(s, '{_RESOLVE}', 1)[i], ''), regexp_extract_all(s, '{_RESOLVE}', 3)[i]) AS INT) AS a0,
    CAST(coalesce(nullif(regexp_extract_all(s, '{_RESOLVE}', 2)[i], ''), nullif(regexp_extract_all(s, '{_RESOLVE}', 4)[i], ''), nullif(regexp_extract_all(s, '{_RESOLVE}', 1)[i], ''), regexp_extract_all(s, '{_RESOLVE}', 3)[i]) AS INT) AS b0 FROM p),
n AS (SELECT DISTINCT lang, source, doc_id, unnest(range(least(a0, b0), least(greatest(a0, b0), least(a0, b0) + 29) + 1)) AS ref FROM g),
e AS (SELECT source, CAST(doc_id % 250 AS INT) AS ref, min(doc_id) AS entry_id FROM documents GROUP BY ALL),
f AS (
  SELECT n.*, entry_id, CASE WHEN row_number() OVER (PARTITION BY lang, n.source, n.ref ORDER BY doc_id) = 1 THEN 1 ELSE 0 END AS new
  FROM n JOIN e ON n.source = e.source AND n.ref = e.ref WHERE n.ref BETWEEN 1 AND 200),
w AS (SELECT *, sum(new) OVER (PARTITION BY lang ORDER BY doc_id, ref ROWS UNBOUNDED PRECEDING) AS place FROM f)
SELECT lang AS query_id, doc_id AS source_id, CAST(ref AS INT) AS ref_number, entry_id, CAST(place AS BIGINT) AS place FROM w WHERE place <= 6""",
    "kept_citations": f"""
WITH {_bm25(6)}, {_ANS},
c AS (
  SELECT query_id, answer, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(answer, '(?i)\\[S(\\d+)\\]', 1), lambda x: CAST(x AS INT)), lambda i: i BETWEEN 1 AND n))) AS kept
  FROM ans JOIN (SELECT query_id, count(*) AS n FROM h GROUP BY query_id) USING (query_id)),
p AS (
  SELECT *, regexp_split_to_array(answer, '(?i)\\[S\\d+\\]') AS parts, list_transform(regexp_extract_all(answer, '(?i)\\[S(\\d+)\\]', 1), lambda x: CAST(x AS INT)) AS nums FROM c),
w AS (
  SELECT *, CASE WHEN len(kept) = 0 THEN answer ELSE regexp_replace(regexp_replace(array_to_string(list_transform(parts, lambda x, i:
    CASE WHEN i > 1 AND coalesce(list_position(kept, nums[i - 1]), 0) > 0 THEN '[S' || list_position(kept, nums[i - 1]) || ']' ELSE '' END || x), ''), '[ \\t]{{2,}}', ' ', 'g'), ' +([,.;:!?])', '\\1', 'g') END AS new_answer FROM p)
SELECT query_id, doc_id AS source_id, rank, CAST(CASE WHEN len(kept) = 0 THEN rank ELSE list_position(kept, CAST(rank AS INT)) END AS BIGINT) AS new_rank, new_answer
FROM w JOIN h USING (query_id) WHERE len(kept) = 0 OR coalesce(list_position(kept, CAST(rank AS INT)), 0) > 0""",
    "verified_answers": f"""
WITH {_bm25(2)}, {_ANS},
v AS (SELECT query_id, count(*) AS n_hits, lower(string_agg(text, chr(10) ORDER BY rank)) AS ev FROM h JOIN documents USING (doc_id) GROUP BY query_id),
m AS (
  SELECT query_id, regexp_extract_all(answer, '\\[S\\d+\\]') AS marks, coalesce(n_hits, 0) AS n_hits, coalesce(ev, '') AS ev, query_id % 11 <> 3 AS g,
    list_filter(list_transform(regexp_extract_all(coalesce(query, ''), '[A-Za-z][A-Za-z0-9-]*|[0-9]+'), lambda t: lower(t)), lambda t: length(t) > 1) AS ents FROM ans LEFT JOIN v USING (query_id)),
u AS (SELECT *, list_filter(ents, lambda e: NOT contains(ev, e)) AS open FROM m),
i AS (
  SELECT *, CASE WHEN g THEN list_filter([CASE WHEN len(marks) = 0 THEN 'answer_missing_source_citations' END, CASE WHEN len(open) > 0 THEN 'uncovered_entities_without_boundary_statement' END,
    CASE WHEN n_hits = 0 THEN 'no_retrieved_evidence' END], lambda x: x IS NOT NULL) ELSE [] END AS issues FROM u)
SELECT query_id, len(list_distinct(marks)) AS citation_count, len(marks) AS raw_citation_count, CASE WHEN g THEN array_to_string(open, ',') ELSE '' END AS uncovered,
  array_to_string(issues, ',') AS issues, len(issues) = 0 AS ok FROM i""",
    "lexical_overlaps": f"SELECT doc_id, round(len(list_intersect(['the', 'and', 'of', 'that', 'de', 'la', 'und', 'der'], {_TOK.format('text')})) / 8.0, 6)::DOUBLE AS overlap FROM documents",
    "best_sentences": f"""
WITH s AS (SELECT doc_id, unnest({_SENT}) AS s, generate_subscripts({_SENT}, 1) AS i FROM documents),
n AS (SELECT *, len(list_filter(['the', 'that', 'un', 'die'], lambda k: contains(lower(s), k))) AS n FROM s),
b AS (SELECT doc_id, s FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i) = 1)
SELECT d.doc_id, coalesce(s, '') AS sentence FROM documents d LEFT JOIN b USING (doc_id)""",
    "sentence_windows": f"""
WITH RECURSIVE t AS (SELECT doc_id, {_SENT} AS ss FROM documents),
n AS (SELECT doc_id, ss, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM t),
b AS (
  SELECT doc_id, ss, i FROM n
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len(list_filter(['the', 'that', 'un', 'die'], lambda k: contains(lower(s), k))) DESC, i) = 1),
w AS (
  SELECT doc_id, ss, i, CAST(i - 1 AS BIGINT) AS l, CAST(i + 1 AS BIGINT) AS r, CAST(length(ss[i]) AS BIGINT) AS total, CAST(1 AS BIGINT) AS parts FROM b
  UNION ALL
  SELECT doc_id, ss, i, l - before, r + after, now + before * coalesce(length(ss[l]), 0), held + before FROM (
    SELECT *, CASE WHEN l >= 1 AND now < 420 AND (now + length(ss[l]) <= 420 OR held = 1) THEN 1 ELSE 0 END AS before FROM (
      SELECT *, total + after * coalesce(length(ss[r]), 0) AS now, parts + after AS held FROM (
        SELECT *, CASE WHEN r <= len(ss) AND (total + length(ss[r]) <= 420 OR parts = 1) THEN 1 ELSE 0 END AS after FROM w WHERE total < 420)))
  WHERE before + after > 0),
g AS (SELECT doc_id, ss[i] AS s, array_to_string(ss[l + 1:r - 1], ' ') AS win FROM w QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY parts DESC) = 1)
SELECT d.doc_id, coalesce(g.s, '') AS sentence, coalesce(g.win, '') AS "window" FROM documents d LEFT JOIN g USING (doc_id)""",
    "literature_ranking": f"""
WITH {_ART},
b AS (SELECT *, title || chr(10) || abstract AS t, lower(title || chr(10) || abstract) AS blob, count(*) OVER (PARTITION BY query_id) AS n FROM a),
m AS (SELECT *, contains(regexp_replace(blob, '[- ]', '', 'g'), 'thand') OR contains(regexp_replace(blob, '[- ]', '', 'g'), 'erin') AS hit FROM b),
f AS (SELECT * FROM m QUALIFY hit OR NOT bool_or(hit) OVER (PARTITION BY query_id)),
s AS (
  SELECT *, {_TIER} AS tier,
    round(0.45 * len(list_intersect({_WANT}, {_TOK.format("title || ' ' || abstract")})) / 4.0 + 0.20 * greatest(0, least(1, 1.0 - (pmid - 1) / n)) + 0.20 * len(list_intersect({_WANT}, {_TOK.format('title')})) / 4.0
      + 0.15 * (greatest(-0.35, least(0.45, {_BONUS})) + 0.35) / 0.8, 6)::DOUBLE AS relevance,
    (lang = 'en' AND doc_id % 2 = 0) AS major, lang = 'en' AS mesh, contains(blob, 'theat') OR contains(blob, 'under') AS tx,
    CAST({_MUST[0].format('blob')} AS INT) + CAST({_MUST[1].format('blob')} AS INT) AS nm, CAST(contains(blob, 'onre') AS INT) + CAST(contains(blob, 'pation') AS INT) AS nl,
    CAST(contains(blob, 'heit') AS INT) + CAST(contains(blob, 'ción') AS INT) AS nr,
    [1.0, 0.9, 0.85, 0.75, 0.4, 0.55][doc_id % 6 + 1] AS js, round(exp(-greatest(0, 2026 - (2000 + doc_id % 27)) / 3.0), 6) AS recency,
    CASE WHEN k = 2 THEN 0.6 ELSE 0 END + CASE WHEN trim(abstract, ' ') = '' THEN 0.5 ELSE 0 END + CASE WHEN lang <> 'en' THEN 0.3 ELSE 0 END + CASE WHEN regexp_matches(title, '(?i)\\bretract') THEN 0.8 ELSE 0 END AS penalty FROM f),
p AS (
  SELECT *, round(greatest(0, least(1, least(1.0, least(1.0, CASE WHEN major THEN 1.0 WHEN mesh THEN 0.85 WHEN tx THEN 0.75 ELSE 0.5 END + 0.12 * nl) + 0.08 * nm)
    - CASE WHEN major OR mesh OR tx THEN 0.08 * nr WHEN nr > 0 THEN 0.55 ELSE 0 END - CASE WHEN nl = 0 THEN 0.12 ELSE 0 END - CASE WHEN nm = 0 THEN 0.15 ELSE 0 END)), 6)::DOUBLE AS population FROM s),
z AS (SELECT *, round(0.40 * population + 0.25 * js + 0.20 * recency + 0.15 * relevance - penalty, 6)::DOUBLE AS score FROM p)
SELECT query_id, pmid, tier, population, relevance, recency, round(penalty, 6)::DOUBLE AS penalty, score,
  row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN population < 0.35 THEN 1 ELSE 0 END, tier, CASE WHEN g THEN 0 ELSE 1 END, score DESC, pmid) AS rank FROM z QUALIFY rank <= 50""",
    "evidence_tiers": f"WITH {_ART}, b AS (SELECT *, title || chr(10) || abstract AS t FROM a) SELECT {_TIER} AS tier, count(*) AS n FROM b GROUP BY ALL",
    "journal_lookup": r"""
WITH n AS (
  SELECT p_partkey AS pos, j, trim(regexp_replace(regexp_replace(replace(lower([p_name, p_brand, p_type][j]), '&', ' and '), '\bthe\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS key
  FROM part, (SELECT unnest([1, 2, 3]) AS j)),
x AS (SELECT key, pos, j FROM n WHERE key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos, j) = 1),
a AS (
  SELECT p_partkey AS pmid, trim(regexp_replace(regexp_replace(replace(lower('The ' || CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE p_name || ' & Co' END), '&', ' and '), '\bthe\b', ' ', 'g'), '[^a-z0-9]+', ' ', 'g')) AS key FROM part),
s AS (SELECT a.key, arg_min(x.pos, x.pos * 10 + x.j) AS pos FROM (SELECT DISTINCT key FROM a WHERE key NOT IN (SELECT key FROM x)) a JOIN x ON contains(a.key, x.key) OR contains(x.key, a.key) GROUP BY a.key)
SELECT pmid, coalesce(x.pos, s.pos) AS journal_pos FROM a LEFT JOIN x ON a.key = x.key LEFT JOIN s ON a.key = s.key""",
    "guideline_citations": r"""
WITH t AS (SELECT doc_id, source, split_part(text, chr(10), 1) AS title FROM documents),
k AS (SELECT *, substr(trim(regexp_replace(lower(title), '[^a-z0-9一-鿿]+', ' ', 'g'), ' '), 1, 160) AS key FROM t)
SELECT key, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, arg_min(title, doc_id) AS label FROM k WHERE key <> '' GROUP BY key""",
    "feedback_classes": """
WITH r AS (SELECT doc_id, lower(trim(coalesce(text, ''), ' ')) AS x, quality, toxic FROM documents JOIN labels USING (doc_id)),
f AS (
  SELECT *, list_filter([CASE WHEN contains(x, '!!') OR contains(x, '***') THEN 'correctness' END, CASE WHEN contains(x, '[') OR contains(x, 'reference') THEN 'evidence' END,
    CASE WHEN contains(x, 'idiot') THEN 'safety' END, CASE WHEN contains(x, 'than') OR contains(x, 'les ') THEN 'positive' END], lambda v: v IS NOT NULL) AS found FROM r),
t AS (SELECT *, CASE WHEN toxic = 1 THEN list_concat(['safety'], list_filter(found, lambda v: v <> 'safety')) ELSE found END AS tags0 FROM f),
z AS (SELECT doc_id, CASE WHEN len(tags0) > 0 THEN tags0 WHEN quality * 5 >= 4 THEN ['positive'] ELSE ['other'] END AS tags FROM t)
SELECT doc_id, tags[1] AS "primary", array_to_string(tags, ',') AS tags FROM z""",
}
