"""Readers and writers at the edges: JSON, XML, event text, CSV, Markdown and traces.

Schemas are explicit and missing fields get their defaults on reading, so a
reader never infers. Tables in between are Parquet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINK = "struct<source_page_code:string,target_pdf_page:int,target_page_code:string,anchor_text:string,edge_type:string>"
PAGE = f"struct<page_id:string,pdf_page:int,page_type:string,clean_text:string,printed_page_code:string,module_code:string,outgoing_links:array<{LINK}>,needs_review:boolean,source:string>"
CHUNK = "struct<chunk_id:string,article_id:string,article_title:string,pdf_page:int,ms_page_code:string,section:string,clean_text:string,reference_ids:array<string>,source:string,content_type:string>"
REFERENCE = "struct<entry_id:string,article_id:string,ref_number:string,text:string,pmid:string,doi:string,url:string,source:string>"
KNOWLEDGE = f"guideline_pages array<{PAGE}>, discussion_chunks array<{CHUNK}>, reference_entries array<{REFERENCE}>, source string"
CHUNKS = f"count long, chunks array<{CHUNK}>"
DECISION = "struct<triple_id:string,decision:string,validation_status:string,confidence:double,reviewer:string,note:string>"


def read_knowledge_base(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of knowledge base files: ``pages``, ``links``, ``chunks``, ``references``."""
    base = spark.read.schema(KNOWLEDGE).json(path, multiLine=True)

    def rows(column: str) -> DataFrame:
        return base.select(F.col("source").alias("base_source"), F.posexplode(column).alias("pos", "x")).select("base_source", "pos", "x.*").withColumn("source", F.coalesce("source", "base_source")).drop("base_source")

    pages = rows("guideline_pages").withColumns({"needs_review": F.coalesce("needs_review", F.lit(False)), "page_type": F.coalesce("page_type", F.lit("clinical_guideline"))})
    links = pages.select("page_id", F.col("printed_page_code").alias("source_code"), F.col("clean_text").alias("text"), F.posexplode("outgoing_links").alias("link", "l"))
    links = links.select("page_id", "source_code", "text", "link", F.col("l.target_pdf_page").alias("target_pdf_page"), F.col("l.target_page_code").alias("target_code"), F.col("l.anchor_text").alias("anchor"), F.col("l.edge_type").alias("kind"))
    chunks = rows("discussion_chunks").withColumns({"content_type": F.coalesce("content_type", F.lit("text")), "reference_ids": F.coalesce("reference_ids", F.array().cast("array<string>"))})
    return {"pages": pages.drop("outgoing_links"), "links": links, "chunks": chunks, "references": rows("reference_entries")}


def resolve_link_codes(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Links that name only a page number get that page's code."""
    codes = pages.select(F.col("pdf_page").alias("target_pdf_page"), F.col("printed_page_code").alias("page_code")).dropDuplicates(["target_pdf_page"])
    return links.join(codes, "target_pdf_page", "left").withColumn("target_code", F.coalesce("target_code", "page_code")).drop("page_code")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks from files that hold ``{"count", "chunks"}`` or a bare list."""
    text = spark.read.text(path, wholetext=True)
    nested = F.from_json("value", CHUNKS)["chunks"]
    bare = F.from_json("value", f"array<{CHUNK}>")
    return text.select(F.posexplode(F.when(F.ltrim("value").startswith("["), bare).otherwise(nested)).alias("pos", "x")).select("pos", "x.*")


def read_review_decisions(spark: SparkSession, path: str) -> DataFrame:
    """Decisions from ``{"decisions": [...]}``, ``{"items": [...]}`` or a bare
    list; the last about a triple counts."""
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", f"struct<decisions:array<{DECISION}>,items:array<{DECISION}>>")
    items = F.when(F.ltrim("value").startswith("["), F.from_json("value", f"array<{DECISION}>")).otherwise(F.coalesce(listed["decisions"], listed["items"]))
    rows = text.select(F.posexplode(items).alias("pos", "x")).select("pos", "x.*").filter(F.trim(F.coalesce("triple_id", F.lit(""))) != "")
    last = F.row_number().over(Window.partitionBy("triple_id").orderBy(F.desc("pos")))
    rows = rows.withColumn("n", last).filter("n = 1").drop("n")
    return rows.select("triple_id", F.coalesce("decision", "validation_status").alias("decision"), F.col("confidence").alias("new_confidence"), "reviewer", "note", "pos")


ARTICLE = """MedlineCitation struct<PMID:struct<_VALUE:string>,Article:struct<ArticleTitle:string,Journal:struct<Title:string,JournalIssue:struct<PubDate:struct<Year:string,MedlineDate:string>>>,
Abstract:struct<AbstractText:array<struct<_Label:string,_VALUE:string>>>,Language:string,PublicationTypeList:struct<PublicationType:array<struct<_VALUE:string>>>>,
MeshHeadingList:struct<MeshHeading:array<struct<DescriptorName:struct<_MajorTopicYN:string,_VALUE:string>>>>>,
PubmedData struct<ArticleIdList:struct<ArticleId:array<struct<_IdType:string,_VALUE:string>>>>"""


def read_articles(spark: SparkSession, path: str) -> DataFrame:
    """Articles from literature XML: labelled abstract sections on lines of their own, major headings apart."""
    rows = spark.read.format("xml").option("rowTag", "PubmedArticle").option("attributePrefix", "_").schema(ARTICLE).load(path)
    a = F.col("MedlineCitation.Article")
    sections = F.transform(a["Abstract"]["AbstractText"], lambda s: F.when(F.coalesce(s["_Label"], F.lit("")) != "", F.concat(s["_Label"], F.lit(": "), s["_VALUE"])).otherwise(s["_VALUE"]))
    heads = F.transform(F.col("MedlineCitation.MeshHeadingList.MeshHeading"), lambda m: m["DescriptorName"])
    date = a["Journal"]["JournalIssue"]["PubDate"]
    doi = F.get(F.filter(F.col("PubmedData.ArticleIdList.ArticleId"), lambda i: i["_IdType"] == "doi"), F.lit(0))["_VALUE"]
    none = F.array().cast("array<string>")
    return rows.select(
        F.col("MedlineCitation.PMID._VALUE").alias("pmid"),
        a["ArticleTitle"].alias("title"),
        F.array_join(F.coalesce(sections, none), "\n").alias("abstract"),
        a["Journal"]["Title"].alias("journal"),
        F.coalesce(date["Year"], F.nullif(F.regexp_extract(date["MedlineDate"], r"(\d{4})", 1), F.lit(""))).alias("year"),
        a["Language"].alias("language"),
        doi.alias("doi"),
        F.coalesce(F.transform(a["PublicationTypeList"]["PublicationType"], lambda p: p["_VALUE"]), none).alias("pub_types"),
        F.coalesce(F.transform(heads, lambda h: h["_VALUE"]), none).alias("mesh"),
        F.coalesce(F.transform(F.filter(heads, lambda h: h["_MajorTopicYN"] == "Y"), lambda h: h["_VALUE"]), none).alias("mesh_major"),
    )


def read_events(spark: SparkSession, path: str, payload: str = "type string, text string") -> DataFrame:
    """Server-sent events: blocks apart by blank lines, each ``data:`` line JSON. Blocks that don't parse have a null ``event``."""
    blocks = spark.read.text(path, lineSep="\n\n").filter(F.col("value").rlike(r"(?m)^data:"))
    data = F.array_join(F.transform(F.filter(F.split("value", "\n"), lambda x: x.startswith("data:")), lambda x: F.ltrim(F.substring(x, F.lit(6), F.length(x)))), "\n")
    return blocks.select(F.from_json(data, payload).alias("event"), data.alias("data"))


def event_text(kind: Column, payload: Column) -> Column:
    """A row as a server-sent event."""
    return F.concat(F.lit("data: "), F.to_json(F.struct(kind.alias("type"), payload.alias("payload"))), F.lit("\n\n"))


def first_json(text: Column, schema: str) -> Column:
    """The first ``{...}`` block of a text, parsed; null if there is none or it doesn't parse."""
    return F.from_json(F.nullif(F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.lit("")), schema)


def json_list(text: Column) -> Column:
    """A JSON list of strings in a text column; anything else is an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


def write_csv(rows: DataFrame, path: str) -> None:
    """CSV with doubled quotes, in the order of ``rows``, as one or more files:
    put together in the order of their names they are one CSV file, whose only
    header is its first line, after a byte order mark."""
    names = rows.columns
    text = ", ".join(f"c{k} string" for k in range(len(names)))
    first = rows.sparkSession.createDataFrame([(0, 0, "\ufeff" + names[0], *names[1:])], f"body int, at long, {text}")
    body = rows.select(F.lit(1), F.monotonically_increasing_id(), *(F.col(f"`{c}`").cast("string") for c in names))
    lines = first.union(body).repartitionByRange("body", "at").sortWithinPartitions("body", "at")
    lines.drop("body", "at").write.csv(path, header=False, quote='"', escape='"')


def write_markdown(pages: DataFrame, path: str) -> None:
    """Pages (``pdf_page``, ``printed_page_code``, ``clean_text``) as Markdown sections, in order within each file."""
    head = F.concat(F.lit("## Page "), F.col("pdf_page").cast("string"), F.coalesce(F.concat(F.lit(" · "), F.col("printed_page_code")), F.lit("")))
    rows = pages.repartitionByRange("pdf_page").sortWithinPartitions("pdf_page")
    rows.select(F.concat(head, F.lit("\n\n"), F.coalesce("clean_text", F.lit("")), F.lit("\n")).alias("value")).write.text(path)


def append_trace(rows: DataFrame, path: str, run_id: str, event: str) -> None:
    """Add rows to a trace of JSON lines."""
    rows.select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("timestamp"), F.lit(run_id).alias("run_id"), F.lit(event).alias("event"), F.struct("*").alias("payload")).write.mode("append").json(path)


def upsert(table: DataFrame, changes: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The table with the last change (by ``order``) of each key in place of its old row."""
    last = changes.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order)))).filter("n = 1").drop("n", order)
    return table.join(last.select(*keys), keys, "left_anti").unionByName(last)


def build_once(spark: SparkSession, path: str, make) -> DataFrame:
    """The table at ``path``; made and written there if there is none."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.parquet(path)
    except AnalysisException:
        make().write.parquet(path)
        return spark.read.parquet(path)
