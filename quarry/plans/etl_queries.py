"""Chunking and page operators over ``documents`` (lines as pieces, sources as articles), layout operators over ``part`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.functions import text as X
from quarry.operators import etl as E
from quarry.plans.search_queries import table


def _pieces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "piece"))


def cleaned_pages(spark, sf_dir):
    noise = (r"(?i)all rights reserved", r"(?i)^licensed under", r"^[A-Z]{2,}!!")
    return table(spark, sf_dir, "documents").select("doc_id", X.clean_lines("text", noise).alias("text"))


def page_kinds(spark, sf_dir):
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", E.is_toc(text).alias("toc"), E.is_reference_page(text).alias("refs"), (F.size(X.paragraphs(text))).alias("paragraphs"))


def book_segments(spark, sf_dir):
    """Sources are books, documents their pages; stand-ins for references are pages with an address or a license."""
    text = F.coalesce("text", F.lit(""))
    refs = E.is_reference_page(text) | text.rlike("@|icense")
    kind = F.when(E.is_toc(text) | text.contains(" | "), "toc").when(refs, "refs").otherwise("body")
    pages = table(spark, sf_dir, "documents").select(F.col("source").alias("book"), F.col("doc_id").alias("page"), kind.alias("kind"))
    return E.segments(pages.filter("book is not null"), stretch=100)


def _source_pages(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("source").alias("article_id"), F.col("doc_id").alias("pos"), "text")


def running_headers(spark, sf_dir):
    return E.running_header(_source_pages(spark, sf_dir), least=1, share=0.0)


def shared_headers(spark, sf_dir):
    return E.running_header(_source_pages(spark, sf_dir), share=0.001)


def section_numbers(spark, sf_dir):
    rows = _pieces(spark, sf_dir).filter(F.trim("piece") != "")
    heading = E.is_heading(F.col("piece"))
    rows = E.islands(rows, "doc_id", ["pos"], heading, "section_no")
    rows = E.carry_forward(rows, "doc_id", ["pos"], F.when(heading, F.col("piece")), "section", "Discussion")
    return rows.select("doc_id", "pos", "section_no", "section")


def packed_chunks(spark, sf_dir):
    rows = _pieces(spark, sf_dir).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "piece"))).alias("p"))
    return rows.select("doc_id", F.posexplode(E.pack(F.transform("p", lambda x: x["piece"]), 1100, "\n")).alias("at", "chunk"))


def section_chunks(spark, sf_dir):
    return E.chunk_sections(_pieces(spark, sf_dir)).select("doc_id", "section_no", "section", "at", "chunk")


def overlap_tails(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", E.overlap_tail(F.col("text"), 160).alias("tail"))


def unique_names(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("-", X.slug("p_brand"), X.slug("p_type")).alias("base"))
    return E.unique_ids(rows, "base", ["p_partkey"]).select("p_partkey", "unique_id")


def column_clusters(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select("s_nationkey", F.col("s_acctbal").alias("x"))
    return E.clusters(rows, "s_nationkey", "x", 400.0).select("s_nationkey", "cluster", F.round("centre", 4).alias("centre"), "n")


def knowledge_union(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    pages = docs.select(F.concat(F.lit("x-"), F.col("doc_id") % 700).alias("source_id"), F.col("doc_id").alias("pos"), "text", F.lit("page").alias("page_type"))
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("x-"), F.col("item_id") * 40).alias("source_id"), F.col("item_id").alias("pos"), "text", F.lit("chunk").alias("page_type"))
    return E.knowledge_documents(pages, items).select("source_id", "page_type", "pos", F.md5("text").alias("text_md5"))


def knowledge_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("lang").alias("page_type"), "text", F.col("source").alias("section"))
    return E.knowledge_stats(docs)


def section_signals(spark, sf_dir):
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), "text")
    return E.section_bounds(pages, {"licence": "(?i)license", "table": r" \| ", "shout": "!!"})


def continued_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_linenumber") % 3 == 1, F.col("l_returnflag")).otherwise("").alias("name"), F.col("l_shipdate").cast("date").cast("string").alias("cell"))
    return E.merge_continuations(rows, "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey"], "name", "cell").select("l_orderkey", "row_no", "name", "cell")


def markdown_tables(spark, sf_dir):
    row = F.array(F.col("c_name"), F.col("c_mktsegment"))
    # A table for each 1,000 customers of a nation, so that none grows with the data.
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey", F.floor(F.col("c_custkey") / 1000).alias("part")).agg(F.sort_array(F.collect_list(row)).alias("rows"))
    return rows.select("c_nationkey", "part", E.table_markdown(F.col("rows")).alias("table"))


def reading_order(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return rows.select("doc_id", X.title_key(F.split_part("text", F.lit("\n"), F.lit(1))).alias("title_key"), X.slug(F.split_part("text", F.lit("\n"), F.lit(1))).alias("slug"), X.snippet("text").alias("snippet"))


_PIECES = "p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS piece, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)"
_SECTIONS = rf"""{_PIECES},
h AS (SELECT *, length(piece) BETWEEN 4 AND 80 AND NOT ends_with(piece, '.') AND regexp_matches(piece, '^\p{{Lu}}') AS heading FROM p WHERE trim(piece, ' ') <> ''),
s AS (
  SELECT *, CAST(sum(CAST(heading AS INT)) OVER w AS BIGINT) AS section_no, coalesce(last_value(CASE WHEN heading THEN piece END IGNORE NULLS) OVER w, 'Discussion') AS section
  FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""



def _tails(source: str, key: str, text: str) -> str:
    """CTEs up to ``tails`` (key, tail): the last whole sentences of a text, up to 160 characters."""
    return f"""
ts AS (
  SELECT {key}, list_filter(string_split(regexp_replace(trim(replace({text}, chr(10), ' '), ' '), '([.。!?！？])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS ss FROM {source}),
tu AS (SELECT {key}, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM ts),
tc AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY i DESC) AS back, sum(length(s)) OVER (PARTITION BY {key} ORDER BY i DESC) AS size FROM tu),
tails AS (SELECT {key}, trim(string_agg(s, ' ' ORDER BY i), ' ') AS tail FROM tc WHERE back = 1 OR size <= 160 GROUP BY ALL)"""


QUERIES = {
    "cleaned_pages": cleaned_pages,
    "page_kinds": page_kinds,
    "book_segments": book_segments,
    "running_headers": running_headers,
    "shared_headers": shared_headers,
    "section_numbers": section_numbers,
    "packed_chunks": packed_chunks,
    "section_chunks": section_chunks,
    "overlap_tails": overlap_tails,
    "unique_names": unique_names,
    "column_clusters": column_clusters,
    "knowledge_union": knowledge_union,
    "knowledge_counts": knowledge_counts,
    "section_signals": section_signals,
    "continued_rows": continued_rows,
    "markdown_tables": markdown_tables,
    "reading_order": reading_order,
}

_HEADERS = r"""
h AS (SELECT source AS article_id, doc_id, trim(regexp_extract(text, '^[ \n]*([^\n]*)', 1), ' ') AS header, count(*) OVER (PARTITION BY source) AS pages FROM documents),
c AS (SELECT article_id, header, count(*) AS n, min(doc_id) AS first, any_value(pages) AS pages FROM h WHERE header <> '' GROUP BY article_id, header),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY n DESC, first) = 1)"""

ORACLE_SQL = {
    "cleaned_pages": r"""
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(regexp_replace(x, '[ \t\r\f]+', ' ', 'g'), ' ')),
  lambda x: x <> '' AND NOT regexp_matches(x, '(?i)all rights reserved') AND NOT regexp_matches(x, '(?i)^licensed under') AND NOT regexp_matches(x, '^[A-Z]{2,}!!')), chr(10)) AS text FROM documents""",
    "page_kinds": r"""
SELECT doc_id, len(regexp_extract_all(text, '(?m)^(.+?)\.{3,}\s*(?:MS-)?(\d+)\s*$')) >= 5 AS toc,
  regexp_matches(text, '(?mi)^\s*references\s*$') OR len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)(ncbi\.nlm\.nih\.gov|doi\.org|pubmed)'))) >= 3
    OR (len(regexp_extract_all(text, '(?m)^\s*\d{1,3}\.\s+[A-Z]')) >= 2 AND len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(?i)(ncbi\.nlm\.nih\.gov|doi\.org|pubmed)'))) >= 2) AS refs,
  CAST(len(list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: trim(x, ' ')), lambda x: x <> '')) AS INT) AS paragraphs FROM documents""",
    "book_segments": r"""
WITH k AS (
  SELECT source AS book, doc_id AS page, CASE WHEN len(regexp_extract_all(t, '(?m)^(.+?)\.{3,}\s*(?:MS-)?(\d+)\s*$')) >= 5 OR contains(t, ' | ') THEN 'toc' WHEN
    regexp_matches(t, '(?mi)^\s*references\s*$') OR n >= 3 OR (len(regexp_extract_all(t, '(?m)^\s*\d{1,3}\.\s+[A-Z]')) >= 2 AND n >= 2) OR regexp_matches(t, '@|icense') THEN 'refs' ELSE 'body' END AS kind
  FROM (SELECT *, coalesce(text, '') AS t, len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '(?i)(ncbi\.nlm\.nih\.gov|doi\.org|pubmed)'))) AS n FROM documents WHERE source IS NOT NULL)),
p AS (SELECT *, last_value(CASE WHEN kind <> 'toc' THEN kind END IGNORE NULLS) OVER (PARTITION BY book ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM k)
SELECT book, page, kind, CAST(CASE WHEN kind <> 'toc' THEN sum(CASE WHEN kind = 'body' AND prior IS DISTINCT FROM 'body' THEN 1 ELSE 0 END) OVER (PARTITION BY book ORDER BY page) END AS BIGINT) AS chapter FROM p""",
    "running_headers": f"WITH {_HEADERS} SELECT article_id, header, n FROM b",
    "shared_headers": f"WITH {_HEADERS} SELECT article_id, header, n FROM b WHERE n >= greatest(3, floor(pages * 0.001))",
    "section_numbers": f"WITH {_SECTIONS} SELECT doc_id, pos, section_no, section FROM s",
    "packed_chunks": f"""
WITH RECURSIVE {_PIECES},
q AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r, piece FROM p),
k AS (
  SELECT doc_id, r, 0 AS c, length(piece) AS size, piece FROM q WHERE r = 1
  UNION ALL
  SELECT q.doc_id, q.r, CASE WHEN k.size + length(q.piece) > 1100 THEN k.c + 1 ELSE k.c END, CASE WHEN k.size + length(q.piece) > 1100 THEN length(q.piece) ELSE k.size + length(q.piece) END, q.piece
  FROM k JOIN q ON k.doc_id = q.doc_id AND q.r = k.r + 1)
SELECT doc_id, c AS "at", string_agg(piece, chr(10) ORDER BY r) AS chunk FROM k GROUP BY doc_id, c""",
    "unique_names": """
WITH b AS (SELECT p_partkey, trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g'), '-') || '-' || trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '-', 'g'), '-') AS base FROM part),
n AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY p_partkey) - 1 AS n FROM b)
SELECT p_partkey, CASE WHEN n = 0 THEN base ELSE base || '-x' || n END AS unique_id FROM n""",
    "column_clusters": """
WITH g AS (SELECT s_nationkey, s_acctbal AS x, CASE WHEN s_acctbal - lag(s_acctbal) OVER w > 400 THEN 1 ELSE 0 END AS new FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal)),
c AS (SELECT *, CAST(sum(new) OVER (PARTITION BY s_nationkey ORDER BY x ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cluster FROM g)
SELECT s_nationkey, cluster, round(avg(x), 4) AS centre, count(*) AS n FROM c GROUP BY ALL""",
    "knowledge_union": """
WITH u AS (
  SELECT 'x-' || doc_id % 700 AS source_id, doc_id AS pos, text, 'page' AS page_type, 0 AS part FROM documents
  UNION ALL SELECT 'x-' || item_id * 40, item_id, text, 'chunk', 1 FROM benchmark)
SELECT source_id, page_type, pos, md5(text) AS text_md5 FROM u WHERE trim(coalesce(text, ''), ' ') <> '' QUALIFY row_number() OVER (PARTITION BY source_id ORDER BY part, pos) = 1""",
    "knowledge_counts": "SELECT lang AS page_type, count(*) AS n, count(text) AS with_text, array_to_string(list_sort(list(DISTINCT source)), ',') AS sections FROM documents GROUP BY lang",
    "section_signals": """
SELECT signal, min(doc_id) AS first, max(doc_id) AS last FROM (
  SELECT doc_id, unnest(list_filter([CASE WHEN regexp_matches(text, '(?i)license') THEN 'licence' END, CASE WHEN contains(text, ' | ') THEN 'table' END, CASE WHEN contains(text, '!!') THEN 'shout' END], lambda x: x IS NOT NULL)) AS signal FROM documents)
GROUP BY signal""",
    "continued_rows": """
WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, CASE WHEN l_linenumber % 3 = 1 THEN l_returnflag ELSE '' END AS name, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS cell FROM lineitem),
i AS (SELECT *, CAST(sum(CASE WHEN name <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY n ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row_no FROM r)
SELECT l_orderkey, row_no, max(CASE WHEN name <> '' THEN name END) AS name, string_agg(cell, ' ' ORDER BY n, cell) AS cell FROM i GROUP BY l_orderkey, row_no""",
    "markdown_tables": """
WITH r AS (SELECT c_nationkey, c_custkey // 1000 AS part, row_number() OVER (PARTITION BY c_nationkey, c_custkey // 1000 ORDER BY c_name, c_mktsegment) AS i, '| ' || c_name || ' | ' || c_mktsegment || ' |' AS line FROM customer)
SELECT c_nationkey, part, string_agg(CASE WHEN i = 1 THEN line || chr(10) || '| --- | --- |' ELSE line END, chr(10) ORDER BY i) AS "table" FROM r GROUP BY c_nationkey, part""",
    "reading_order": r"""
SELECT doc_id, substr(trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9一-鿿]+', ' ', 'g'), ' '), 1, 160) AS title_key,
  trim(regexp_replace(lower(split_part(text, chr(10), 1)), '[^a-z0-9]+', '-', 'g'), '-') AS slug, substr(replace(text, chr(10), ' '), 1, 320) AS snippet FROM documents""",
    "overlap_tails": f"WITH {_tails('documents', 'doc_id', 'text')} SELECT d.doc_id, coalesce(tail, '') AS tail FROM documents d LEFT JOIN tails USING (doc_id)",
    "section_chunks": f"""
WITH RECURSIVE {_SECTIONS},
q AS (SELECT doc_id, section_no, section, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY pos) AS r, piece FROM s),
k AS (
  SELECT doc_id, section_no, section, r, 0 AS c, length(piece) AS size, piece FROM q WHERE r = 1
  UNION ALL
  SELECT q.doc_id, q.section_no, q.section, q.r, CASE WHEN k.size + length(q.piece) > 1100 THEN k.c + 1 ELSE k.c END, CASE WHEN k.size + length(q.piece) > 1100 THEN length(q.piece) ELSE k.size + length(q.piece) END, q.piece
  FROM k JOIN q ON k.doc_id = q.doc_id AND k.section_no = q.section_no AND q.r = k.r + 1),
b AS (SELECT doc_id, section_no, section, c, string_agg(piece, chr(10) || chr(10) ORDER BY r) AS chunk FROM k GROUP BY ALL),
{_tails('b', 'doc_id, section_no, c', 'chunk')}
SELECT b.doc_id, b.section_no, section, b.c AS "at", CASE WHEN b.c > 0 THEN coalesce(tail, '') || chr(10) || chr(10) || chunk ELSE chunk END AS chunk
FROM b LEFT JOIN tails ON b.doc_id = tails.doc_id AND b.section_no = tails.section_no AND b.c = tails.c + 1""",
}
