"""Search documents from pages, chunks and references; evidence for prompts; lookups with a second way; fields of free text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import contains_any, page_code
from quarry.operators.ranking import Concepts, mentions

COLUMNS = ("source_id", "page_type", "pdf_page", "text", "printed_page_code", "module_code", "section", "article_id", "reference_ids", "needs_review", "source", "content_type")
ROUTES = (r"(?i)\bPMID:?\s*(\d{5,9})", r"(?i)\b(10\.\d{4,9}/[^\s;,]+)", r"(https?://[^\s;,]+)")


def page_documents(pages: DataFrame) -> DataFrame:
    """Pages as search documents; the id is made of the printed code, else of the page number, in every index."""
    code = F.nullif(page_code("printed_page_code"), F.lit(""))
    key = F.concat(F.lit("page-"), F.coalesce(F.regexp_replace(code, " ", "_"), F.col("pdf_page").cast("string")))
    none = F.lit(None).cast("string")
    return pages.select(key.alias("source_id"), "page_type", "pdf_page", F.col("clean_text").alias("text"), "printed_page_code", "module_code", none.alias("section"), none.alias("article_id"), F.array().cast("array<string>").alias("reference_ids"), "needs_review", "source", F.lit("text").alias("content_type"))


def chunk_documents(chunks: DataFrame) -> DataFrame:
    """Chunks of discussions as search documents."""
    none = F.lit(None).cast("string")
    return chunks.select(F.col("chunk_id").alias("source_id"), F.lit("discussion").alias("page_type"), "pdf_page", F.col("clean_text").alias("text"), F.col("ms_page_code").alias("printed_page_code"), none.alias("module_code"), "section", "article_id", "reference_ids", F.lit(False).alias("needs_review"), "source", "content_type")


def reference_documents(references: DataFrame) -> DataFrame:
    """Reference entries as search documents."""
    none = F.lit(None).cast("string")
    return references.select(F.col("entry_id").alias("source_id"), F.lit("reference").alias("page_type"), F.lit(None).cast("int").alias("pdf_page"), "text", none.alias("printed_page_code"), none.alias("module_code"), none.alias("section"), "article_id", F.array("ref_number").alias("reference_ids"), F.lit(False).alias("needs_review"), "source", F.lit("text").alias("content_type"))


def search_documents(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Clinical pages and chunks that have text, the first of each id."""
    a = page_documents(pages.filter("page_type = 'clinical_guideline'")).withColumn("part", F.lit(0))
    both = a.unionByName(chunk_documents(chunks).withColumn("part", F.lit(1))).filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    first = Window.partitionBy("source_id").orderBy("part", "pdf_page")
    return both.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n", "part")


def evidence_blocks(hits: DataFrame, mark: str = "S", chars: int = 1200) -> DataFrame:
    """One text per query: its hits in rank order as ``[S1] title`` and an excerpt."""
    block = F.concat(F.lit(f"[{mark}"), F.col("rank").cast("string"), F.lit("] "), F.concat_ws(" · ", "title"), F.lit("\n"), F.substring(F.coalesce("text", F.lit("")), 1, chars))
    rows = hits.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", block.alias("block")))).alias("blocks"))
    return rows.select("query_id", F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n").alias("evidence"))


def append_summaries(docs: DataFrame, summaries: DataFrame) -> DataFrame:
    """Add a page's summary, found by its code, to the text of its documents."""
    known = summaries.select(page_code("code").alias("k"), "summary").dropDuplicates(["k"])
    rows = docs.withColumn("k", page_code("printed_page_code")).join(known, "k", "left")
    return rows.withColumn("text", F.when(F.coalesce("summary", F.lit("")) != "", F.concat("text", F.lit("\n"), "summary")).otherwise(F.col("text"))).drop("k", "summary")


def exact_or_prefix(rows: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """``value`` of the cache for each key: of an equal key, else of the first key that starts with it."""
    exact = rows.join(cache.select(F.col("key").alias(key), "value"), key, "left")
    open_ = exact.filter("value is null").select(key).distinct()
    starts = F.transform(F.sequence(F.lit(0), F.length("key")), lambda n: F.substring("key", 1, n))
    # For each start of a cached key, the first key that has it: one row, whatever the number of keys.
    first = cache.select(F.explode(starts).alias("start"), "key", "value").groupBy("start").agg(F.min_by("value", "key").alias("near"))
    first = first.withColumnRenamed("start", key)
    near = open_.join(first, key)
    return exact.join(near, key, "left").withColumn("value", F.coalesce("value", "near")).drop("near")


def attach_figures(figures: DataFrame, hits: DataFrame) -> DataFrame:
    """The hit that a figure belongs to: by page code, else by page number; the last hit of either counts."""
    by_code = hits.filter("printed_page_code is not null").groupBy("query_id", page_code("printed_page_code").alias("code")).agg(F.max("rank").alias("code_rank"))
    by_page = hits.groupBy("query_id", "pdf_page").agg(F.max("rank").alias("page_rank"))
    rows = figures.withColumn("code", page_code("page_code")).join(by_code, ["query_id", "code"], "left").join(by_page, ["query_id", "pdf_page"], "left")
    return rows.withColumn("source_index", F.coalesce("code_rank", "page_rank")).drop("code", "code_rank", "page_rank")


def reference_entries(pages: DataFrame) -> DataFrame:
    """pages: ``article_id``, ``text``. Numbered entries with the ids that their text names, the first of each number."""
    parts = F.split(F.concat(F.lit("\n"), "text"), r"\n\s*(?=\d{1,3}\.\s+\S)")
    rows = pages.select("article_id", F.posexplode(parts).alias("at", "entry")).filter(F.col("entry").rlike(r"^\d{1,3}\.\s"))
    rows = rows.withColumn("ref_number", F.regexp_extract("entry", r"^(\d+)", 1)).withColumn("text", F.trim(F.regexp_replace(F.regexp_replace("entry", r"^\d+\.\s+", ""), r"\s+", " ")))
    first = Window.partitionBy("article_id", "ref_number").orderBy("at")
    rows = rows.withColumn("n", F.row_number().over(first)).filter("n = 1")
    ids = [F.nullif(F.regexp_replace(F.regexp_extract("text", p, 1), r"\.$", ""), F.lit("")).alias(n) for n, p in zip(("pmid", "doi", "url"), ROUTES, strict=True)]
    return rows.select("article_id", "ref_number", F.concat(F.lit("ref-"), "article_id", F.lit("-"), "ref_number").alias("entry_id"), "text", *ids)


def citation_parts(text: Column) -> Column:
    """Authors, title, journal and year of a citation in the Vancouver style."""
    pattern = r"^(.+?)\.\s+(.+?)[.?!]\s+(.+?)[.;]?\s+(?:19|20)\d\d"
    part = lambda k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    return F.struct(part(1).alias("authors"), part(2).alias("title"), part(3).alias("journal"), F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d\d)\b", 1), F.lit("")).alias("year"))


def article_predicate(blob: Column, concepts: Concepts, level: int = 0) -> Column:
    """Whether an article matches a question: each group of terms by any of its
    members. Level 0 asks for all groups, 1 drops the line of therapy, 2 asks for
    the disease and any other group's term."""
    groups = [concepts.target_terms, concepts.biomarkers, concepts.interventions, *([tuple(t for line in concepts.lines for t in line)] if level == 0 else [])]
    tests = [reduce(lambda a, b: a | b, [mentions(blob, t.lower()) for t in g]) for g in groups if g]
    if level < 2 or len(tests) < 3:
        return reduce(lambda a, b: a & b, tests, F.lit(True))
    return tests[0] & reduce(lambda a, b: a | b, tests[1:])


def fetch_in_order(asked: DataFrame, articles: DataFrame) -> DataFrame:
    """Articles for the ids asked (``pmid``, ``place``), in that order; ids without an article are left out."""
    return asked.join(articles, "pmid").orderBy("place")


def variant_gate(text: Column, gene: Column, tokens: Column) -> Column:
    """Whether a record speaks of the gene and of any name of the variant."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return low.contains(F.lower(gene)) & F.exists(tokens, lambda t: (t != "") & low.contains(F.lower(t)))


def status_gate(status: Column, disease: Column, allowed: tuple[str, ...] = ("accepted", "submitted"), wanted: tuple[str, ...] = ("lymphoma", "dlbcl")) -> Column:
    """Whether a record's status and disease let it pass."""
    return F.lower(F.coalesce(status, F.lit(""))).isin(*allowed) & contains_any(F.lower(F.coalesce(disease, F.lit(""))), wanted)


def case_fields(text: Column) -> Column:
    """Age, sex, stage, index score and marker results that a case description names."""
    pick = lambda p, k=1: F.nullif(F.regexp_extract(text, p, k), F.lit(""))
    sex = F.when(text.rlike(r"(?i)\bfemale\b|\bwoman\b|女"), "female").when(text.rlike(r"(?i)\bmale\b|\bman\b|男"), "male")
    names = F.regexp_extract_all(text, F.lit(r"\b(CD\d+|BCL2|BCL6|MYC|MUM1|Ki-?67)\s*[:：]?\s*(\+|-|positive|negative|\d{1,3}\s*%)"), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(r"\b(CD\d+|BCL2|BCL6|MYC|MUM1|Ki-?67)\s*[:：]?\s*(\+|-|positive|negative|\d{1,3}\s*%)"), F.lit(2))
    return F.struct(
        F.coalesce(pick(r"(\d{1,3})\s*岁"), pick(r"(?i)(\d{1,3})[- ]year")).cast("int").alias("age"),
        sex.alias("sex"),
        F.upper(pick(r"(?i)stage\s*(IV|III|II|I)\b")).alias("stage"),
        pick(r"(?i)\b(?:aa)?IPI\s*[:：=]?\s*(\d)").cast("int").alias("ipi"),
        F.arrays_zip(names.alias("marker"), values.alias("value")).alias("markers"),
    )
