from pyspark.sql import functions as F

from quarry.operators import documents as D
from quarry.operators.ranking import Concepts


def test_search_documents_have_one_key(spark):
    pages = spark.createDataFrame([("p1", 5, "clinical_guideline", "text", "bcel-a 1 of 3", "BCEL", True, "g"), ("p2", 6, "clinical_guideline", "t", None, None, False, "g"), ("p3", 7, "clinical_guideline", " ", "X-1", "X", False, "g"), ("p4", 8, "discussion", "t", "Y-1", "Y", False, "g")], "page_id string, pdf_page int, page_type string, clean_text string, printed_page_code string, module_code string, needs_review boolean, source string")
    chunks = spark.createDataFrame([("c1", 9, "MS-1", "S", "art", "body", ["3"], "g", "table"), ("c1", 10, "MS-2", "S", "art", "again", ["4"], "g", "text")], "chunk_id string, pdf_page int, ms_page_code string, section string, article_id string, clean_text string, reference_ids array<string>, source string, content_type string")
    got = {r["source_id"]: r for r in D.search_documents(pages, chunks).collect()}
    assert got.keys() == {"page-BCEL-A_1_OF_3", "page-6", "c1"} and got["c1"]["text"] == "body" and tuple(got["c1"].asDict()) == D.COLUMNS
    refs = spark.createDataFrame([("r1", "art", "3", "t", "g")], "entry_id string, article_id string, ref_number string, text string, source string")
    assert D.reference_documents(refs).first()["reference_ids"] == ["3"] and tuple(D.reference_documents(refs).columns) == D.COLUMNS
    added = D.append_summaries(D.page_documents(pages), spark.createDataFrame([("BCEL-A  1 of 3", "sum")], "code string, summary string"))
    assert {r["text"] for r in added.filter("needs_review").collect()} == {"text\nsum"}


def test_evidence_and_figures(spark):
    hits = spark.createDataFrame([(1, 2, "b", "body b", "A-2", 4), (1, 1, None, None, None, 3)], "query_id int, rank int, title string, text string, printed_page_code string, pdf_page int")
    assert D.evidence_blocks(hits).first()["evidence"] == "[S1] \n\n\n[S2] b\nbody b"
    figures = spark.createDataFrame([(1, "a-2", 9), (1, None, 3), (1, "Z-9", 99)], "query_id int, page_code string, pdf_page int")
    assert sorted(str(r["source_index"]) for r in D.attach_figures(figures, hits).collect()) == ["1", "2", "None"]


def test_lookups_fall_back_to_prefixes(spark):
    rows = spark.createDataFrame([("p1:Table 1",), ("p1:",), ("p9",)], "key string")
    cache = spark.createDataFrame([("p1:Table 1", "x"), ("p1:Other", "o")], "key string, value string")
    assert {r["key"]: r["value"] for r in D.exact_or_prefix(rows, cache).collect()} == {"p1:Table 1": "x", "p1:": "o", "p9": None}


def test_reference_lists_and_citations(spark):
    text = "References\n1. Smith J, Doe A. A study of things. Blood. 2019;1:2. PMID: 123456 doi 10.1/xx\n 2. Two\n lines https://a.b/c\n1. Again"
    got = {r["ref_number"]: r for r in D.reference_entries(spark.createDataFrame([("art", text)], "article_id string, text string")).collect()}
    assert got.keys() == {"1", "2"} and got["1"]["pmid"] == "123456" and got["2"]["text"] == "Two lines https://a.b/c" and got["2"]["url"] == "https://a.b/c"
    parts = spark.createDataFrame([("Smith J, Doe A. A study of things. Blood. 2019;1:2.",)], "t string").select(D.citation_parts(F.col("t")).alias("c")).first()["c"]
    assert (parts["authors"], parts["title"], parts["journal"], parts["year"]) == ("Smith J, Doe A", "A study of things", "Blood", "2019")


def test_article_levels_and_gates(spark):
    c = Concepts(biomarkers=("TP53",), interventions=("R-CHOP",), target_terms=("dlbcl",), lines=(("first-line",),))
    rows = spark.createDataFrame([("dlbcl tp53 rchop first-line",), ("dlbcl tp53 r-chop",), ("dlbcl tp53",), ("tp53 r-chop",)], "t string")
    assert [[r[0] for r in rows.select(D.article_predicate(F.col("t"), c, k)).collect()] for k in range(3)] == [[True, False, False, False], [True, True, False, False], [True, True, True, False]]
    one = spark.createDataFrame([("TP53 R175H seen", "TP53", ["Arg175His", "R175H"])], "t string, g string, n array<string>")
    assert one.select(D.variant_gate(F.col("t"), F.col("g"), F.col("n")), D.status_gate(F.lit("Accepted"), F.lit("Follicular Lymphoma"))).first() == (True, True)
    asked = spark.createDataFrame([("b", 1), ("a", 2), ("z", 3)], "pmid string, place int")
    assert [r["pmid"] for r in D.fetch_in_order(asked, spark.createDataFrame([("a",), ("b",)], "pmid string")).collect()] == ["b", "a"]


def test_case_fields(spark):
    text = "62-year-old woman, stage IV, IPI: 3, CD20 +, Ki-67: 80%, MYC negative"
    r = spark.createDataFrame([(text,)], "t string").select(D.case_fields(F.col("t")).alias("c")).first()["c"]
    assert (r["age"], r["sex"], r["stage"], r["ipi"]) == (62, "female", "IV", 3)
    assert [(m["marker"], m["value"]) for m in r["markers"]] == [("CD20", "+"), ("Ki-67", "80%"), ("MYC", "negative")]
