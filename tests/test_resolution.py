"""Entities of questions, scopes, staged graph search and page layout on small literal rows."""

import pytest
from pyspark.sql import functions as F

from quarry.functions import text as X_
from quarry.operators import citations as C
from quarry.operators import conversations as V
from quarry.operators import etl as E
from quarry.operators import layout as L
from quarry.operators import molecular as M
from quarry.operators import resolution as X
from quarry.operators import search as S
from quarry.operators.knowledge import Entity
from quarry.operators.scope import ScopeRule

ENTITIES = (Entity("Disease", "DLBCL", ("弥漫大b细胞淋巴瘤", r"\bdlbcl\b")), Entity("Regimen", "R-CHOP", ("r-chop", "r chop")), Entity("Gene", "TP53", ("tp53", "p53")), Entity("Marker", "Old p53", ("p53",)))


def names(spark, *texts, phrases=None):
    rows = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    out = {}
    for r in X.resolve_entities(rows, ENTITIES, phrases or {}).collect():
        out.setdefault(r["query_id"], set()).add(r["name"])
    return out


def test_entities_by_token_then_name_then_phrase(spark):
    got = names(spark, "DLBCL一线, 用R-CHOP?", "p53 mutated", None, "nothing here", "abTP53cd")
    # Of equal aliases the last holds; what no token names is looked for as a part of a word.
    assert got[0] == {"DLBCL", "R-CHOP"} and got[1] == {"Old p53"} and 2 not in got and 3 not in got and got[4] == {"TP53"}
    assert names(spark, "does CAR-T help", phrases={"car-t": "TP53", "help": "unknown"}) == {0: {"TP53"}}


def test_query_expansion(spark):
    rows = spark.createDataFrame([(1, " TP53 治疗 "), (2, None), (3, "治疗")], "query_id int, query string")
    got = {r["query_id"]: r for r in X.expand_queries(rows, {"治疗": "therapy", "预后": "prognosis"}, "[A-Z]{2}[0-9]+", ("tp53", "myc"), ((r"^TP", "mutation"),)).collect()}
    assert got[1]["entities"] == ["TP53", "tp53"] and got[1]["searches"] == ["TP53 治疗", "therapy", "TP53 tp53", "TP53 mutation"]
    assert got[2]["searches"] == [] and got[3]["searches"] == ["治疗", "therapy"]


def test_scopes_bind_each_question(spark):
    docs = spark.createDataFrame(
        [(1, "cell therapy", "clinical_guideline", "BCEL", None), (2, "cell therapy", "clinical_guideline", "FOLL", None), (3, "cell therapy", "discussion", None, "fl"), (4, "cell therapy", "other", None, None), (5, None, None, None, None)],
        "doc_id long, text string, page_type string, module_code string, article_id string",
    )
    scopes = S.with_common(spark.createDataFrame([("fl", ["FOLL"], ["fl"]), ("all", [], [])], "scope string, modules array<string>, articles array<string>"), ["COM"], ["common"])
    assert {r["scope"]: (r["modules"], r["articles"]) for r in scopes.collect()} == {"fl": (["FOLL", "COM"], ["fl", "common"]), "all": ([], [])}
    asked = spark.createDataFrame([(1, "follicular cell"), (2, "cell"), (3, "zzz")], "query_id long, query string")
    hits = S.retrieve(docs, asked, scopes, (ScopeRule("fl", "follic", 5), ScopeRule("odd", "zzz", 1)))
    found = {}
    for r in hits.collect():
        found.setdefault((r["query_id"], r["scope"]), []).append(r["doc_id"])
    assert {k: sorted(v) for k, v in found.items()} == {(1, "fl"): [2, 3, 4], (2, "all"): [1, 2, 3, 4]}


def test_several_texts_of_one_question_are_searched_together(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue whale"), (3, "green")], "doc_id long, text string")
    many = spark.createDataFrame([(7, ["red fox", "blue red"])], "query_id long, query array<string>")
    one = spark.createDataFrame([(7, "red fox blue")], "query_id long, query string")
    rows = lambda q: S.bm25_search(docs, q, 5).collect()
    assert rows(many) == rows(one) and {r["doc_id"] for r in rows(one)} == {1, 2}
    assert S.bm25_search(docs.limit(0), one, 5).count() == 0 and S.bm25_search(docs, one.limit(0), 5).count() == 0


def test_vectors_keep_one_best_list(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(5000)] + [(9000, None), (9001, [0.0, 0.0])], "vec_id long, embedding array<double>").repartition(2)
    asked = spark.createDataFrame([(1, [6.0, 1.0]), (2, [0.0, 0.0])], "query_id long, vector array<double>")
    got = S.vector_search(rows, asked, 3).collect()
    assert [(r["query_id"], r["doc_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 6, 1.0), (1, 13, 1.0), (1, 20, 1.0)]


def test_stages_merge_best_first(spark):
    kind = "query_id int, triple_id string, score double, confidence double"
    a = spark.createDataFrame([(1, "x", 0.5, 0.9), (1, "y", 0.9, 0.1)], kind)
    b = spark.createDataFrame([(1, "x", 0.8, 0.2), (1, "z", 0.8, 0.3), (2, "x", 0.1, 0.1)], kind)
    got = [(r["query_id"], r["triple_id"], r["stage"], r["rank"]) for r in X.merge_hits([a, b], 2).orderBy("query_id", "rank").collect()]
    assert got == [(1, "y", 0, 1), (1, "z", 1, 2), (2, "x", 1, 1)]


def test_edges_need_names(spark):
    edges = spark.createDataFrame([("1", "a", "TREATS", "b"), ("2", "a", "EDGE", "c"), ("3", "a", "TREATS", "d"), ("4", "x", "TREATS", "y")], "edge_id string, source string, relation string, target string")
    nodes = spark.createDataFrame([("a", "Alpha", "k"), ("b", "Beta", "k"), ("c", "Gamma", "k"), ("d", "d", "k"), ("x", "X1", "k"), ("y", None, "k")], "node string, name string, kind string")
    asked = spark.createDataFrame([(1, "what about beta")], "query_id int, query string")
    near = spark.createDataFrame([(1, "a"), (1, "b"), (1, "x")], "query_id int, entity string")
    assert sorted((r["triple_id"], r["score"]) for r in X.edge_triples(edges, nodes, asked, near).collect()) == [("edge:1", 0.88), ("edge:2", 0.66)]


def test_rollup_and_sources(spark):
    chunks = spark.createDataFrame([("c1", "a", 1, None, [2, 1, 2]), ("c2", "a", 2, "T", [9]), ("c3", "b", 1, "", None)], "chunk_id string, article_id string, pos int, title string, reference_ids array<int>")
    refs = spark.createDataFrame([("a", 1, "e1"), ("a", 1, "e1b"), ("a", 2, "e2"), ("z", 5, "e5")], "article_id string, ref_number int, entry_id string")
    got = {r["article_id"]: (r["title"], r["chunk_count"], r["reference_count"]) for r in X.article_rollup(chunks, refs).collect()}
    assert got == {"a": ("T", 2, 3), "b": ("b", 1, 0), "z": ("z", 0, 1)}
    assert {r["chunk_id"]: r["source_ids"] for r in X.chunk_sources(chunks, refs).collect()} == {"c1": ["c1", "e2", "e1b", "e2"], "c2": ["c2"], "c3": ["c3"]}


def test_rows_drift_with_their_words(spark):
    words = spark.createDataFrame([(1, k, float(x), y) for k, (x, y) in enumerate([(0, 0.0), (10, 6.0), (20, 10.0), (0, 30.0), (5, 31.0)])] + [(2, 9, 0.0, 5.0)], "page int, word_id int, x0 double, y0 double")
    got = {r["word_id"]: r["row"] for r in L.row_groups(words).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 9: 0}


def test_wrapped_headings_are_one(spark):
    rows = [("d", 1, 1, "FIRST PART OF", True), ("d", 2, 1, "A TITLE\nbody", True), ("d", 3, 2, "NEXT PAGE", True), ("d", 4, 2, "text", False), ("d", 5, 2, "Mixed Case", True), ("d", 6, 2, "LAST", True)]
    got = [(r["pos"], r["text"]) for r in L.merge_headings(spark.createDataFrame(rows, "doc_id string, pos int, page int, text string, is_heading boolean")).orderBy("pos").collect()]
    assert got == [(1, "FIRST PART OF A TITLE\nbody"), (3, "NEXT PAGE"), (4, "text"), (5, "Mixed Case"), (6, "LAST")]


def test_superscripts_offsets_and_footers(spark):
    spans = spark.createDataFrame([(1, 1, 10.0, 50.0, "word"), (1, 2, 10.0, 50.0, "more"), (1, 6, 10.0, 50.0, "words"), (1, 7, 10.0, 50.0, "here"), (1, 3, 6.0, 46.0, "3, 5–7"), (1, 4, 6.0, 50.0, "8"), (1, 5, 6.0, 46.0, "th")], "line_id int, span_id int, size double, y double, text string")
    assert [r["span_id"] for r in L.superscripts(spans).collect()] == [3]
    pages = spark.createDataFrame([("a", 4, "contents\n1"), ("a", 6, "KEY table\n900\n2\n"), ("a", 9, "KEY table\n3"), ("b", 1, "x"), ("c", 3, "KEY")], "doc_id string, page int, text string")
    assert {r["doc_id"]: r["ahead"] for r in L.printed_offset(pages, F.col("text").contains("KEY"), 18).collect()} == {"a": 4, "b": 18, "c": 2}
    blocks = spark.createDataFrame([(1, 1, 90.0, 10.0, "BCEL-9"), (1, 2, 60.0, 95.0, " BCEL-A  1 OF 5 "), (1, 3, 60.0, 96.0, "BCEL-1"), (2, 4, 10.0, 95.0, "BCEL-2"), (3, 5, 60.0, 95.0, "page 3")], "page int, block_id int, x0 double, y0 double, text string")
    assert [(r["page"], r["code"]) for r in L.footer_codes(blocks, F.lit(100.0), F.lit(100.0)).collect()] == [(1, "BCEL-A 1 OF 5")]


@pytest.mark.parametrize("x0, x1, lane", [(5.0, 95.0, "full"), (5.0, 45.0, "left"), (55.0, 95.0, "right")])
def test_lanes(spark, x0, x1, lane):
    assert spark.range(1).select(L.lane(F.lit(x0), F.lit(x1), F.lit(50.0)).alias("l")).first()["l"] == lane


def of(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column(F.col("x"))).first()[0]


def test_text_repairs_and_predicates(spark):
    assert of(spark, " a­b \t c‑d\n\n\n\ne ", X_.plain_spaces) == "ab c-d\n\ne"
    assert of(spark, "1 ~ 2 and a~b~c ~", X_.wide_tildes) == "1～2 and a～b～c ~" and of(spark, "x�Cy", X_.repaired_dashes) == "x–y"
    assert [of(spark, n, X_.is_safe_image) for n in ("a：b.PNG", "a/b.png", "..png", "a.jpg", "a\n.png", None)] == [True, False, False, False, False, False]
    assert [of(spark, n, X_.is_noise_label) for n in ("", None, "12", "[3]", "Node_4", "edge", "R-CHOP", "page one")] == [True] * 6 + [False] * 2


def test_seed_pages_by_rule_then_by_hit(spark):
    asked = spark.createDataFrame([(1, "Relapsed disease"), (2, "other"), (3, "none")], "query_id int, query string")
    hits = spark.createDataFrame([(1, 1, "clinical_guideline", "BCEL-9"), (2, 1, "clinical_guideline", "BCEL-A 1 OF 3"), (2, 2, "discussion", "BCEL-1"), (2, 3, "clinical_guideline", "bcel-7"), (2, 4, "clinical_guideline", "BCEL-8")], "query_id int, rank int, page_type string, code string")
    got = {r["query_id"]: (r["seed"], r["origin"]) for r in X.seed_pages(asked, hits, [(("relapse", "refractory"), "BCEL-5"), (("disease",), "BCEL-1")]).collect()}
    assert got == {1: ("BCEL-5", "intent_map"), 2: ("BCEL-7", "hit_fallback"), 3: (None, "none")}
    assert of(spark, "弥漫大 B 细胞淋巴瘤 12", lambda c: X.chapter_of(c, [("淋巴瘤", "all"), ("弥漫大B细胞淋巴瘤", "dlbcl")])) == "dlbcl"


def test_stand_ins_focus_and_concepts(spark):
    hits = spark.createDataFrame([(1, 1, "s1", "P-1", "t1"), (1, 2, "s2", "", "t2"), (1, 3, "s3", "P-3", "t3"), (2, 1, "s4", None, None)], "query_id int, rank int, source_id string, code string, text string")
    seeds = spark.createDataFrame([(1, "seed", 1), (1, "more", 2)], "query_id int, item string, position int")
    got = {r["triple_id"]: r["score"] for r in X.source_triples(hits, seeds).collect()}
    assert got == {"synth:1:seed:P-1": 0.61, "synth:2:seed:s2": 0.64, "synth:1:s4:s4": 0.61}
    edges = spark.createDataFrame([("a", "r", "b"), ("b", "r", "a"), ("b", "r", "c"), ("a", "r", "a")], "source string, relation string, target string")
    found = X.node_focus(edges, spark.createDataFrame([(1, "a")], "query_id int, entity string")).collect()
    assert sorted((r["source"], r["target"]) for r in found) == [("a", "a"), ("a", "b"), ("b", "a")]
    nodes = spark.createDataFrame([("n2", "R-CHOP", "Regimen"), ("n1", " r-chop ", "Drug"), ("n3", None, "Page"), ("n4", "x", "Triple")], "node string, label string, kind string")
    assert {r["concept"]: (r["kind"], r["n"], r["nodes"]) for r in X.merged_concepts(nodes).collect()} == {"r-chop": ("Drug", 2, ["n1", "n2"]), "n3": ("Page", 1, ["n3"])}
    row = X.graph_statistics(spark.createDataFrame([("trusted",), ("needs_review",)], "validation_status string"), spark.range(5), spark.range(0)).first()
    assert (row["triples"], row["trusted"], row["candidates"], row["rejected"]) == (2, 1, 5, 0)


def test_tables_shares_and_counts(spark):
    paragraphs = spark.createDataFrame([(1, 0, "no"), (1, 1, "see [S2][s3]"), (1, 2, "[S2] again")], "query_id int, at int, text string")
    tables = spark.createDataFrame([(1, 2), (1, 9)], "query_id int, number int")
    assert {r["number"]: r["at"] for r in C.place_tables(paragraphs, tables).collect()} == {2: 1, 9: None}
    messages = spark.createDataFrame([(1, 0, 0, None, 1), (1, 1, 1, 0, None), (1, 2, 2, 0, None), (2, 0, 0, None, None)], "conv_id int, id int, pos int, parent_id int, active_child_id int")
    shares = spark.createDataFrame([("t", 1), ("gone", 7)], "token string, conv_id int")
    assert [(r["token"], r["id"]) for r in V.shared_paths(shares, messages).orderBy("depth").collect()] == [("t", 0), ("t", 1)]
    conversations = spark.createDataFrame([(1, 5, "2024-01-01"), (2, 5, "2024-02-01"), (3, 6, "2024-01-01")], "conv_id int, user_id int, updated_at string")
    assert sorted((r["conv_id"], r["n_messages"], r["place"]) for r in V.conversation_list(conversations, messages, F.lit(5)).collect()) == [(1, 3, 2), (2, 1, 1)]
    chunks = spark.createDataFrame([("a", "table"), ("a", None), ("b", "text")], "article_id string, content_type string")
    assert {r["article_id"]: (r["chunks"], r["tables"]) for r in E.chunk_counts(chunks).collect()} == {"a": (2, 1), "b": (1, 0)}


def test_molecular_levels_counts_and_annotations(spark):
    levels = [("Likely pathogenic", "", "L5"), ("Pathogenic somatic", "", "L4"), ("Oncogenic", "", "L4"), ("Uncertain", "4 stars", "L5"), ("benign", "3 stars", "L4"), (None, None, "L5")]
    rows = spark.createDataFrame(levels, "c string, r string, want string").withColumn("got", M.clinvar_level(F.col("c"), F.col("r"))).collect()
    assert all(r["got"] == r["want"] for r in rows)
    items = [("a", "x", "Supports", "L2"), ("B", "Predictive", "no", "L2"), ("c", None, None, "L3"), ("E", "prognostic", "", "L3"), (None, None, None, "L4")]
    rows = spark.createDataFrame(items, "l string, k string, d string, want string").withColumn("got", M.civic_level(F.col("l"), F.col("k"), F.col("d"))).collect()
    assert all(r["got"] == r["want"] for r in rows)
    cards = spark.createDataFrame([("p", M.DIRECT), ("p", None), ("q", M.NEAR)], "provider string, disease_match string")
    assert {r["provider"]: (r["cards"], r["direct"], r["near"], r["proxy"]) for r in M.card_counts(cards).collect()} == {"p": (2, 1, 0, 1), "q": (1, 0, 1, 0)}
    genes = spark.createDataFrame([("TP53", "suppressor")], "gene string, value string")
    got = M.annotate(spark.createDataFrame([("TP53",), ("XYZ",), (None,)], "gene string"), {"role": (genes, "unknown")}).collect()
    assert {r["gene"]: r["role"] for r in got} == {"TP53": "suppressor", "XYZ": "unknown", None: "unknown"}
