"""Search over ``documents`` with the ``benchmark`` items as questions, and over ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import search as S
from quarry.operators.index import TextIndex
from quarry.operators.vector_index import VectorIndex
from quarry.tables import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


#: Documents as search documents: the language is the page type, the source the article.
FILTERS = S.MetadataFilters(page_types=("en", "fr"), article_ids=("src1", "src2", "src3"), module_type="", article_types=("en",))


def bm25_topk(spark, sf_dir):
    return S.bm25_search(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 10).select("query_id", "doc_id", "score", "rank")


def bm25_filtered(spark, sf_dir):
    where = FILTERS.column(page_type="lang", article="source")
    return S.bm25_search(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 10, where).select("query_id", "doc_id", "score", "rank")


def index_topk(spark, sf_dir):
    """The documents of each language are a batch of a stored index."""
    docs = table(spark, sf_dir, "documents")
    index = TextIndex(spark, new_path(spark, "index"), keep=("lang", "source"))
    english = F.coalesce(F.col("lang") == "en", F.lit(False))
    index.add(docs.filter(english))
    index.add(docs.filter(~english))
    return index.search(questions(spark, sf_dir), 10)


def index_filtered(spark, sf_dir):
    """A language is deleted from the index, and searches are bound to others."""
    docs = table(spark, sf_dir, "documents")
    index = TextIndex(spark, new_path(spark, "index"), keep=("lang", "source"))
    index.add(docs)
    index.delete(docs.filter("lang = 'de'").select("doc_id"))
    return index.search(questions(spark, sf_dir), 10, FILTERS.column(page_type="lang", article="source"))


def search_cascade(spark, sf_dir):
    hits = S.cascade(table(spark, sf_dir, "documents"), questions(spark, sf_dir))
    return hits.select("query_id", "doc_id", "pre_rerank_score", "lexical_overlap", "score", "rank")


def term_statistics(spark, sf_dir):
    posts = S.postings(table(spark, sf_dir, "documents"))
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def corpus_statistics(spark, sf_dir):
    return S.corpus_statistics(table(spark, sf_dir, "documents")).withColumn("avgdl", F.round("avgdl", 6))


def _query_vectors(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").filter("vec_id % 20 = 0")
    return rows.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def vector_topk(spark, sf_dir):
    return S.vector_search(table(spark, sf_dir, "embeddings"), _query_vectors(spark, sf_dir), 10).select("query_id", "doc_id", "score", "rank")


def vector_index_topk(spark, sf_dir):
    """The vectors of the even and odd labels are two batches of a stored index."""
    vectors = table(spark, sf_dir, "embeddings")
    index = VectorIndex(spark, new_path(spark, "vectors"))
    index.learn(vectors)
    even = F.coalesce(F.col("label") % 2 == 0, F.lit(False))
    index.add(vectors.filter(even))
    index.add(vectors.filter(~even))
    return index.search(_query_vectors(spark, sf_dir), 10)


def vector_index_deleted(spark, sf_dir):
    """The vectors of a label are deleted from the index."""
    vectors = table(spark, sf_dir, "embeddings")
    index = VectorIndex(spark, new_path(spark, "vectors"))
    index.add(vectors)
    index.delete(vectors.filter("label = 3").select("vec_id"))
    return index.search(_query_vectors(spark, sf_dir), 10)


def _both(spark, sf_dir):
    lexical = S.bm25_search(table(spark, sf_dir, "documents"), questions(spark, sf_dir), 16)
    vectors = table(spark, sf_dir, "embeddings")
    asked = questions(spark, sf_dir).join(vectors, F.col("query_id") == F.col("vec_id")).select("query_id", F.col("embedding").alias("vector"))
    return lexical, S.vector_search(vectors, asked, 16)


def hybrid_fusion(spark, sf_dir):
    return S.fuse(*_both(spark, sf_dir)).select("query_id", "doc_id", "retriever", "score", "first_rank", "rank")


def rank_fusion(spark, sf_dir):
    return S.reciprocal_rank_fusion(list(_both(spark, sf_dir)), 10).select("query_id", "doc_id", "score", "rank")


def query_routing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("query"))
    return S.route(docs, flow=("therapy", "the", "pour"), evidence=("reference", "das", "pour")).select("doc_id", "route", F.array_join("triggers", ",").alias("triggers"))


def hashed_bag_vectors(spark, sf_dir):
    return S.hashed_vectors(table(spark, sf_dir, "documents"))


TERMS = "list_filter(list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z][A-Za-z0-9-]*|[0-9]+'), lambda t: lower(t)), lambda t: length(t) > 1)"
TOKENS = "list_distinct(list_transform(regexp_extract_all(coalesce({0}, ''), '[a-zA-Z0-9]+'), lambda t: lower(t)))"


def _bm25(k: int, where: str = "true", corpus: str = "true") -> str:
    return f"""
d AS (SELECT doc_id, lang, source, text, {TERMS.format('text')} AS ts FROM documents WHERE {corpus}),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TERMS.format('text')}) AS term FROM benchmark),
st AS (SELECT count(*) AS n, greatest(sum(len(ts)) / greatest(count(*), 1), 1) AS avgdl FROM d),
e AS (SELECT doc_id, lang, source, greatest(len(ts), 1) AS dl, unnest(ts) AS term FROM d),
tf AS (SELECT term, doc_id, lang, source, dl, count(*) AS tf FROM e WHERE term IN (SELECT term FROM q) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (
  SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))), 6) AS score
  FROM tf JOIN df USING (term) JOIN q USING (term) CROSS JOIN st WHERE {where} GROUP BY query_id, doc_id),
h AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0 QUALIFY rank <= {k})"""


_DENSE = """
x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
g AS (
  SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round(list_cosine_similarity(a.v, b.v), 6) + 0.0 AS score
  FROM x a CROSS JOIN x b WHERE a.vec_id IN (SELECT {0})),
v AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM g QUALIFY rank <= {1})"""

_BOTH = f"WITH {_bm25(16)}, {_DENSE.format('item_id FROM benchmark', 16)}"

QUERIES = {
    "bm25_topk": bm25_topk,
    "bm25_filtered": bm25_filtered,
    "index_topk": index_topk,
    "index_filtered": index_filtered,
    "search_cascade": search_cascade,
    "term_statistics": term_statistics,
    "corpus_statistics": corpus_statistics,
    "vector_topk": vector_topk,
    "vector_index_topk": vector_index_topk,
    "vector_index_deleted": vector_index_deleted,
    "hybrid_fusion": hybrid_fusion,
    "rank_fusion": rank_fusion,
    "query_routing": query_routing,
    "hashed_bag_vectors": hashed_bag_vectors,
}

ORACLE_SQL = {
    "bm25_topk": f"WITH {_bm25(10)} SELECT query_id, doc_id, score, rank FROM h",
    "bm25_filtered": f"""WITH {_bm25(10, "lang IN ('en', 'fr') AND (lang <> 'en' OR source IN ('src1', 'src2', 'src3'))")} SELECT query_id, doc_id, score, rank FROM h""",
    "index_topk": f"WITH {_bm25(10)} SELECT query_id, doc_id, score, rank FROM h",
    "index_filtered": f"""WITH {_bm25(10, "lang IN ('en', 'fr') AND (lang <> 'en' OR source IN ('src1', 'src2', 'src3'))", "lang IS DISTINCT FROM 'de'")} SELECT query_id, doc_id, score, rank FROM h""",
    "search_cascade": f"""
WITH {_bm25(40)},
o AS (
  SELECT query_id, h.doc_id, score AS pre_rerank_score,
    round(len(list_intersect({TOKENS.format('b.text')}, {TOKENS.format('d.text')})) / greatest(len({TOKENS.format('b.text')}), 1), 6) AS lexical_overlap
  FROM h JOIN d ON h.doc_id = d.doc_id JOIN benchmark b ON b.item_id = query_id WHERE rank <= 16),
r AS (SELECT *, round(pre_rerank_score + lexical_overlap, 6) AS score FROM o)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r QUALIFY rank <= 6""",
    "term_statistics": f"""
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY term""",
    "corpus_statistics": f"""
SELECT count(*) AS n_docs, CAST(sum(len({TERMS.format('text')})) AS BIGINT) AS n_terms, round(sum(len({TERMS.format('text')})) / greatest(count(*), 1), 6) AS avgdl FROM documents""",
    "vector_topk": f"WITH {_DENSE.format('vec_id FROM embeddings WHERE vec_id % 20 = 0', 10)} SELECT * FROM v",
    "vector_index_topk": f"WITH {_DENSE.format('vec_id FROM embeddings WHERE vec_id % 20 = 0', 10)} SELECT * FROM v",
    "vector_index_deleted": f"WITH {_DENSE.format('vec_id FROM embeddings WHERE vec_id % 20 = 0', 10).replace('CROSS JOIN x b WHERE', 'CROSS JOIN x b WHERE b.vec_id IN (SELECT vec_id FROM embeddings WHERE label IS DISTINCT FROM 3) AND')} SELECT * FROM v",
    "hybrid_fusion": f"""
{_BOTH},
m AS (
  SELECT query_id, doc_id, h.score AS a, v.score AS b, least(h.rank, v.rank) AS first_rank FROM h FULL JOIN v USING (query_id, doc_id)),
f AS (
  SELECT query_id, doc_id, CASE WHEN a IS NULL THEN 'embedding' WHEN b IS NULL THEN 'bm25' ELSE 'hybrid' END AS retriever,
    round(CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN greatest(a * 0.6, b * 0.4) ELSE coalesce(a, b) END, 6) AS score, first_rank FROM m)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f""",
    "rank_fusion": f"""
{_BOTH},
f AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 6) AS score FROM (SELECT query_id, doc_id, rank FROM h UNION ALL SELECT query_id, doc_id, rank FROM v) GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 10""",
    "query_routing": """
WITH t AS (
  SELECT doc_id, lower(coalesce(text, '')) AS x FROM documents),
h AS (
  SELECT doc_id, list_filter(['therapy', 'the', 'pour'], lambda w: contains(x, w)) AS f, list_filter(['reference', 'das', 'pour'], lambda w: contains(x, w)) AS e FROM t)
SELECT doc_id, CASE WHEN len(f) > 0 AND len(e) > 0 THEN 'hybrid' WHEN len(f) > 0 THEN 'flowchart' ELSE 'evidence' END AS route,
  array_to_string(list_sort(list_distinct(list_concat(f, e))), ',') AS triggers FROM h""",
    "hashed_bag_vectors": f"""
WITH e AS (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents),
c AS (SELECT doc_id, CAST(('0x' || substr(md5(term), 1, 8)) AS BIGINT) % 64 AS bucket, count(*) AS n FROM e GROUP BY ALL)
SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM c""",
}
