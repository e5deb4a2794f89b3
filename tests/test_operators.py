"""Rules on small literal rows, with Chinese text where the tables have none."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import conversations
from quarry.functions import citations as N
from quarry.functions import text as X
from quarry.operators import citations as C
from quarry.operators import etl as E
from quarry.operators import graph as G
from quarry.operators import knowledge as K
from quarry.operators import molecular as M
from quarry.operators import ranking as R
from quarry.operators import search as S


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x"))).first()[0]


def test_tokenizers_differ(spark):
    assert one(spark, "R-CHOP 一线治疗 x 12", X.search_terms) == ["r-chop", "一线治疗", "12", "一线", "线治", "治疗"]
    assert one(spark, "R-CHOP x 一线 x", X.token_set) == ["r", "chop", "x", "一线"]
    assert one(spark, None, X.search_terms) == []


def test_page_codes_and_keys(spark):
    assert one(spark, " bcel-a  1 of 3 ", X.page_code) == "BCEL-A 1 OF 3"
    assert [one(spark, c, X.is_decision_page) for c in ("BCEL-3", "BCEL-A 1 OF 3", "BCEL-6B")] == [True, False, False]
    assert one(spark, "BCEL-3", X.module_of) == "BCEL" and one(spark, "", X.module_of) is None
    assert one(spark, "https://doi.org/10.1/AbC.", X.doi_key) == "10.1/abc"
    assert one(spark, "The Lancet & Oncology", X.journal_key) == "lancet and oncology"


def test_reference_numbers(spark):
    assert one(spark, "shown.45-47 and [3], also .05", N.inline_refs) == [3, 5, 45, 46, 47]
    assert one(spark, "见【7–5】，and [201] (199)", N.resolver_refs) == [5, 6, 7, 199]
    assert one(spark, "[9] then [2-4] [1-90] [9]", N.bracket_refs) == [9, 2, 3, 4]
    assert one(spark, "3, 5-7,x,400", N.superscript_refs) == [3, 5, 6, 7]
    assert one(spark, "none", N.bracket_refs) == []


def test_answers_keep_cited_hits_only(spark):
    hits = spark.createDataFrame([(q, k, f"s{q}{k}") for q in (1, 2) for k in (1, 2, 3)], "query_id int, rank int, source_id string")
    answers = spark.createDataFrame([(1, "b [S3] and [s9] , a [S1]."), (2, "no marks")], "query_id int, answer string")
    got = {(r["query_id"], r["source_id"]): (r["new_rank"], r["new_answer"]) for r in C.keep_cited(answers, hits).collect()}
    text = "b [S2] and, a [S1]."
    assert got == {(1, "s11"): (1, text), (1, "s13"): (2, text), (2, "s21"): (1, "no marks"), (2, "s22"): (2, "no marks"), (2, "s23"): (3, "no marks")}


def test_references_stop_at_the_cap_and_link_twice(spark):
    schema = "query_id int, rank int, source_id string, article_id string, text string, keywords array<string>, reference_ids array<int>"
    hits = spark.createDataFrame([(1, 1, "a", "x", "Far [9]. dlbcl here [1-3].", ["dlbcl"], list(range(10))), (1, 2, "b", "x", "dlbcl [2] [5] [6].", ["dlbcl"], [2, 5, 6])], schema)
    entries = spark.createDataFrame([("x", n, f"r{n}") for n in (1, 2, 3, 5, 6, 9)], "article_id string, ref_number int, entry_id string")
    got = [(r["source_id"], r["ref_number"]) for r in C.resolve_references(hits, entries, 4).collect()]
    assert sorted(got) == [("a", 1), ("a", 2), ("a", 3), ("b", 2), ("b", 5)]


def test_verifier(spark):
    schema = "answer string, entities array<string>, evidence string, n_hits int, n_figures int, kind string"
    rows = [
        ("fine [S1][S1][S2]", ["TP53"], "about tp53", 2, 0, "guideline"),
        ("没有直接提及", ["MYC"], "", 0, 0, "guideline"),
        ("x [S1]\n来源：", ["MYC"], "y", 1, 1, "guideline"),
        ("hello", ["MYC"], "", 0, 0, "chitchat"),
    ]
    got = [(r["citation_count"], r["raw_citation_count"], r["issues"], r["ok"]) for r in C.verify_answers(spark.createDataFrame(rows, schema)).collect()]
    assert got == [(2, 3, [], True), (0, 0, ["answer_missing_source_citations", "no_retrieved_evidence"], False), (1, 1, ["answer_contains_inline_sources"], False), (0, 0, [], True)]


def test_filters_bind_their_own_types(spark):
    rows = spark.createDataFrame([("clinical_guideline", "A", None, None), ("clinical_guideline", "B", None, "s"), ("discussion", None, "x", "s"), ("discussion", None, "y", None), ("reference", None, "x", None)], "page_type string, module_code string, article_id string, section string")
    count = lambda **k: rows.filter(S.MetadataFilters(**k).column()).count()
    assert (count(), count(module_codes=("A",)), count(article_ids=("x",)), count(sections=("s",)), count(page_types=("reference",))) == (5, 4, 4, 2, 1)


def test_statistics_cover_what_a_filter_hides(spark):
    docs = spark.createDataFrame([(1, "apple pie", "a"), (2, "apple tart", "b"), (3, "plum pie", "b")], "doc_id long, text string, page_type string")
    asked = spark.createDataFrame([(1, "apple pie")], "query_id long, query string")
    all_ = {r["doc_id"]: r["score"] for r in S.bm25_search(docs, asked, 10).collect()}
    some = {r["doc_id"]: r["score"] for r in S.bm25_search(docs, asked, 10, S.MetadataFilters(page_types=("b",)).column()).collect()}
    assert max(all_, key=all_.get) == 1 and some == {k: all_[k] for k in (2, 3)}


def test_fusion_keeps_the_larger_weighted_score(spark):
    schema = "query_id long, doc_id long, score double, rank int"
    a, b = spark.createDataFrame([(1, 1, 10.0, 1), (1, 2, 5.0, 2)], schema), spark.createDataFrame([(1, 2, 0.9, 1), (1, 3, 0.8, 2)], schema)
    assert [(r["doc_id"], r["score"], r["retriever"]) for r in S.fuse(a, b).orderBy("rank").collect()] == [(1, 10.0, "bm25"), (2, 3.0, "hybrid"), (3, 0.8, "embedding")]


def test_routes(spark):
    rows = spark.createDataFrame([("复发 therapy",), ("预后 therapy",), ("definition",), ("hello",)], "query string")
    assert [(r["route"], r["triggers"]) for r in S.route(rows).collect()] == [("flowchart", ["therapy", "复发"]), ("hybrid", ["therapy", "预后"]), ("evidence", ["definition"]), ("evidence", [])]


def test_evidence_tiers(spark):
    rows = [
        ("Randomized phase III trial of x", "", ["Journal Article"], False, "E1"),
        ("ZUMA-1: phase 2 study", "", ["Clinical Trial, Phase II"], False, "E2"),
        ("Real-world outcomes of a cohort", "", ["Journal Article"], False, "E4"),
        ("A case", "", ["Case Reports"], False, "E5"),
        ("A case", "", ["Case Reports"], True, "E1"),
        ("Narrative", "", ["Review"], False, "E5"),
        ("Pooled", "", ["Systematic Review", "Review"], False, "E1"),
        ("Prospective cohort", "", ["Journal Article"], False, "E3"),
    ]
    frame = spark.createDataFrame(rows, "t string, a string, p array<string>, g boolean, want string")
    got = frame.select(R.evidence_tier(F.col("t"), F.col("a"), F.col("p"), F.col("g")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_navigation_fans_out_within_its_module(spark):
    pages = spark.createDataFrame([(f"M-{k}", t) for k, t in enumerate(["start", "alpha", "beta drug", "gamma", "delta"])] + [("X-1", "beta")], "code string, summary string")
    links = spark.createDataFrame([("M-0", "m-1", "a", None), ("M-0", "M-2", "beta", None), ("M-0", "X-1", "beta", None), ("M-0", "M-3", "Index", None), ("M-2", "M-4", "d", "flow"), ("M-2", "M-0", "back", "flow")], "source_code string, target_code string, anchor string, kind string")
    start = spark.createDataFrame([(1, "beta drug", "m-0")], "query_id long, query string, code string")
    walk = lambda **k: [r["code"] for r in G.navigate(pages, links, start, **k).orderBy("place").collect()]
    assert walk(fanout=1, depth=1, budget=1) == ["M-2"]
    assert walk(fanout=3, depth=2, budget=9) == ["M-2", "M-1", "M-4"]


def test_graph_search_prefers_therapy(spark):
    schema = "triple_id string, subject_id string, subject_name string, relation string, object_id string, object_name string, object_type string, confidence double, validation_status string, review_status string, evidence_kind string, evidence_text string, evidence_source_ids array<string>"
    rows = [
        ("t1", "d", "DLBCL", "RECOMMENDS", "r", "R-CHOP therapy", "Treatment", 0.9, "trusted", "auto", "guideline", "R-CHOP is preferred first-line therapy for DLBCL patients", ["a", "b"]),
        ("t2", "d", "DLBCL", "ASSOCIATED_WITH", "l", "LDH", "Biomarker", 0.95, "trusted", "auto", "text", "LDH", ["a"]),
        ("t3", "r", "R-CHOP therapy", "REQUIRES", "e", "Echo", "Test", 0.8, "needs_review", "auto", "text", "echo before therapy", ["a"]),
    ]
    triples = spark.createDataFrame(rows, schema)
    seeds, asked = spark.createDataFrame([(1, "d")], "query_id long, entity string"), spark.createDataFrame([(1, "first-line therapy")], "query_id long, query string")
    got = [r["triple_id"] for r in G.retrieve(triples, seeds, asked, hops=1).orderBy("rank").collect()]
    assert got == ["t1", "t3"]
    assert [r["triple_id"] for r in G.subgraph(triples, seeds, 0).orderBy("rank").collect()] == ["t2", "t1"]
    assert {r["triple_id"] for r in G.lexical_fallback(triples, spark.createDataFrame([(1, "ldh x")], "query_id long, query string")).collect()} == {"t2"}


def test_triples_from_sentences(spark):
    entities = (K.Entity("Disease", "DLBCL", ("dlbcl",)), K.Entity("Treatment", "R-CHOP", ("r-chop",)))
    chunks = spark.createDataFrame([("c1", "R-CHOP is recommended for DLBCL。另一句。", ["r1"])], "chunk_id string, text string, source_ids array<string>")
    rows = K.sentence_triples(chunks, entities, {"RECOMMENDS": ("recommended",), "REQUIRES": ("requires",)})
    rules = spark.createDataFrame([("Disease", "RECOMMENDS", "Treatment")], "subject_type string, relation string, object_type string")
    good, bad = K.validate(rows, rules)
    r = good.first()
    assert (r["subject_id"], r["object_id"], r["confidence"], r["validation_status"], r["evidence_source_ids"]) == ("disease:dlbcl", "treatment:r-chop", 0.86, "trusted", ["c1", "r1"])
    assert r["triple_id"].startswith("triple:") and len(r["triple_id"]) == 15 and bad.count() == 0
    assert K.review_queue(good, bad).count() == 1


def test_packing_and_tails(spark):
    assert one(spark, ["aaaa", "bbbb", "cc", "d" * 9], lambda c: E.pack(c, 8, "|"), "array<string>") == ["aaaa|bbbb", "cc", "d" * 9]
    assert one(spark, [], lambda c: E.pack(c, 8), "array<string>") == []
    assert one(spark, "One. Two two. Three.", lambda c: E.overlap_tail(c, 14)) == "Two two. Three."
    assert one(spark, [["a|b", None], ["c\nd", "e"]], E.table_markdown, "array<array<string>>") == "| a\\|b |  |\n| --- | --- |\n| c d | e |"


def test_variants(spark):
    rows = spark.createDataFrame([(1, "TP53 R175H and TP53 p.R175H, EZH2 c.1937A>T p.Tyr646Phe; MYD88 L265P")], "request_id int, text string")
    got = [(r["gene"], r["cdna"], r["protein"], r["status"]) for r in M.parse_variants(rows).orderBy("at").collect()]
    assert got == [("TP53", None, "p.Arg175His", "protein_level_only"), ("EZH2", "c.1937A>T", "p.Tyr646Phe", "cdna_level"), ("MYD88", None, "p.Leu265Pro", "protein_level_only")]


def test_record_matching_and_gates(spark):
    variants = spark.createDataFrame([(1, "v1", "TP53", "p.Arg175His"), (1, "v2", "MYC", None)], "request_id int, variant_id string, gene string, protein string")
    records = spark.createDataFrame([(1, "r1", "v2", "x", 1), (1, "r2", None, "Arg175His in", 2), (1, "r3", None, "about MYC", 3), (1, "r4", None, "nothing", 4)], "request_id int, record_id string, variant_id string, text string, pos int")
    assert {r["record_id"]: r["variant_id"] for r in M.match_variants(records, variants).collect()} == {"r1": "v2", "r2": "v1", "r3": "v2", "r4": None}
    cards = spark.createDataFrame([(1, 1, "A", "family", "allow"), (1, 2, "B", "direct", "downgrade"), (1, 3, "A", "direct", "downgrade")], "request_id int, pos int, level string, match string, decision string")
    assert [r["pos"] for r in M.rank_cards(cards).orderBy("rank").collect()] == [3, 2, 1]
    assert M.decision_of(cards).first()["decision"] == "downgrade"
    matches = spark.createDataFrame([("DLBCL", "dlbcl"), ("Follicular lymphoma", "Mantle lymphoma"), ("myeloma", "lymphoma x"), ("lung", "lymphoma"), ("", "x")], "a string, b string")
    assert [r[0] for r in matches.select(M.disease_match(F.col("a"), F.col("b"))).collect()] == ["direct", "family", "group", "other", "unknown"]


def test_relaxing_queries():
    assert [R.relax(c) for c in ([400], [6, 9], [2, 3, 1], [0, 0, 0], [1, 5])] == [-1, 0, 1, 2, 1]


def test_tree_walks_have_no_row_limit_and_end_on_circles(spark):
    rows = [(1, k, (k - 1) // 2 if k else None, k, None) for k in range(31)] + [(2, 5, 6, 0, None), (2, 6, 5, 1, None)]
    messages = spark.createDataFrame(rows, "conv_id long, id long, parent_id long, pos long, active_child_id long")
    heads = spark.createDataFrame([(1, 0)], "conv_id long, head_id long")
    spark.conf.set("spark.sql.cteRecursionRowLimit", "10")
    try:
        got = conversations.subtrees(messages, heads).collect()
        assert sorted((r["id"], r["depth"]) for r in got) == [(k, (k + 1).bit_length() - 1) for k in range(31)]
        path = conversations.active_paths(messages).collect()
        assert sorted((r["depth"], r["id"]) for r in path) == [(0, 0), (1, 2), (2, 6), (3, 14), (4, 30)]
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
    with pytest.raises(ValueError):
        conversations.subtrees(messages.filter("conv_id = 2"), spark.createDataFrame([(2, 5)], "conv_id long, head_id long"))


def test_calls_of_the_null_key_share_its_limit(spark):
    from quarry.operators import activity

    rows = spark.createDataFrame([(k, None, f"2024-01-01 00:00:0{k}") for k in range(3)] + [(k, 7, f"2024-01-01 00:00:0{k}") for k in (5, 6)], "event_id long, key long, ts string")
    got = {r["event_id"]: r["allowed"] for r in activity.rate_limited(rows, 1, 60).collect()}
    assert got == {0: True, 1: False, 2: False, 5: True, 6: False}
    hits = {r["event_id"]: r["hit"] for r in activity.cache_hits(rows, 60).collect()}
    assert hits == {0: False, 1: True, 2: True, 5: False, 6: True}


def test_fused_hits_that_need_no_review_come_first(spark):
    from quarry.operators import search

    a = spark.createDataFrame([(1, 5, 0.5, 1, True), (1, 6, 0.5, 2, False), (1, 7, 0.9, 3, None)], "query_id int, doc_id int, score double, rank int, needs_review boolean")
    b = spark.createDataFrame([(1, 8, 0.5, 1), (1, 7, 0.1, 2)], "query_id int, doc_id int, score double, rank int")
    got = search.fuse(a, b).orderBy("rank").select("doc_id", "score", "needs_review").collect()
    assert [tuple(r) for r in got] == [(7, 0.54, False), (6, 0.5, False), (8, 0.5, False), (5, 0.5, True)]
