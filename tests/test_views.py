"""Concept graphs, figures of answers and word grids: odd rows, ties, and plain loops beside them."""

import random

from pyspark.sql import functions as F

from quarry.operators import concepts as K
from quarry.operators import figures as I
from quarry.operators import grids as W
from quarry.operators import layout as L
from quarry.plans import view_queries as V

NODES = "node string, kind string, label string, relation string, subject_id string, subject_name string, object_id string, object_name string, extra int"


def test_triple_nodes_become_edges(spark):
    nodes = spark.createDataFrame(
        [
            ("a", "Drug", "R-CHOP", None, None, None, None, None, 1),
            ("b", "Drug", "r chop", None, None, None, None, None, 1),
            ("c", None, "DLBCL", None, None, None, None, None, 1),
            ("d", "X", None, None, None, None, None, None, 1),
            ("t1", "TrustedTriple", "l", "treats", "c", "zzz", None, "DLBCL", 1),  # subject by edges, object by name
            ("t2", "triple", "l", None, "b", None, "gone", "New Thing", 1),  # relation is the label; an id without a node
            ("t3", "triple", None, None, None, "Made up", "d", None, 1),  # structural: no relation, no label
            ("t4", "triple", None, "rel", None, "R-CHOP", "a", None, 1),  # a loop
            ("t5", "triple", None, "rel", "a", None, None, "  ", 1),  # no object
            ("t6", "triple", None, "rel", None, "...", "nowhere", None, 1),  # names and ids without letters or nodes
            (None, "triple", None, "rel", "a", None, "c", None, 1),
            ("a", "Drug", "R-CHOP", None, None, None, None, None, 2),  # a row again
        ],
        NODES,
    )
    edges = spark.createDataFrame(
        [("b", "subject_of", "t1"), ("d", "SUBJECT_OF", "t1"), ("a", "uses", "c"), ("b", "Uses", "c"), ("a", "EDGE", "c"), ("a", "uses", "t1"), ("a", None, "c"), ("gone", "uses", "a"), ("c", "part of", "d"), (None, "uses", "c")],
        "source string, relation string, target string",
    )
    rows = sorted(tuple(r) for r in K.concept_edges(nodes, edges).select("source", "relation", "target").collect())
    assert rows == [("...", "REL", "nowhere"), ("dlbcl", "PART OF", "d"), ("rchop", "L", "newthing"), ("rchop", "TREATS", "dlbcl"), ("rchop", "USES", "dlbcl")]
    assert K.concept_edges(nodes.limit(0), edges).count() == 0
    assert K.concept_edges(nodes, edges.limit(0)).count() == 2  # by its properties t1 is a loop


def test_views_beside_a_queue(spark):
    random.seed(5)
    links = {(f"n{random.randrange(60):02}", f"n{random.randrange(60):02}") for _ in range(80)}
    links |= {("hub", f"n{k:02}") for k in range(60)} | {(f"p{k:02}", f"p{k + 1:02}") for k in range(30)}
    ways = {}
    for a, b in links:
        if a != b:
            ways.setdefault(a, set()).add(b)
            ways.setdefault(b, set()).add(a)
    centers = ["hub", "p00", "p15", "n01", "n02", "nobody"]

    def walk(center, most):
        seen, queue = {center: 0}, [center]
        while queue and len(seen) < most:
            at = queue.pop(0)
            for b in sorted(ways.get(at, ())):
                if b not in seen and len(seen) < most:
                    seen[b] = seen[at] + 1
                    queue.append(b)
        return [(c, d, i + 1) for i, (c, d) in enumerate(seen.items())]

    edges = spark.createDataFrame([(a, "r", b) for a, b in links], "source string, relation string, target string")
    asked = spark.createDataFrame([*enumerate(centers), (None, "hub"), (9, None), (0, "hub")], "query_id int, concept string")
    for most in (1, 18):
        view = K.concept_view(edges, asked, most)
        got = {}
        for r in view.orderBy("position").collect():
            got.setdefault(r["query_id"], []).append((r["concept"], r["depth"], r["position"]))
        assert got == {i: walk(c, most) for i, c in enumerate(centers)}
    shown = {(r["query_id"], r["source"], r["target"]) for r in K.view_edges(edges, view).collect()}
    kept = {i: {c for c, _, _ in walk(c, 18)} for i, c in enumerate(centers)}
    assert shown == {(i, a, b) for i in kept for a, b in links if a in kept[i] and b in kept[i]}
    assert K.concept_view(edges, asked.limit(0)).count() == 0 and K.concept_view(edges.limit(0), asked).count() == len(centers)


FIGURES = "query_id int, figure string, place int, page_code string, pdf_page int, source_index int, extra string"
HITS = "query_id int, rank int, page_code string, pdf_page int"


def test_figures_by_tiers(spark):
    figures = [
        (1, "f1", 1, "a-1", 1, None, ""), (1, "f2", 2, "B-2", 2, 2, ""), (1, "f3", 3, "c-3", 3, None, ""),  # [S2], page C-3 without a hit
        (2, "g1", 1, "x-1", 8, None, ""), (2, "g2", 2, None, 5, None, ""), (2, "g3", 3, "S-9", 7, None, ""),  # cited hit of page 5
        (3, "h1", 1, "x-1", 8, None, ""), (3, "h2", 2, "s-9", 9, None, ""), (3, "h2", 4, "zz", 9, None, ""),  # nothing cited: seed
        (4, "i1", 2, None, None, None, ""), (4, "i0", 1, None, None, 1, ""),  # nothing at all: the first
        (5, "j1", 1, "q-1", 1, 1, ""), (5, "j2", 2, "q-2", 1, 7, ""), (5, "j3", 3, "s-9", 1, None, ""), (5, "j4", 4, "Q-1  2 of  3", 2, None, ""),  # its hit's page is named; [S7] has no hit
        (6, "k1", 1, "a-1", 1, None, ""),  # no answer row
    ]
    hits = [(1, 1, "A-1", 1), (1, 2, "B-2", 2), (2, 1, "Y-1", 4), (2, 2, None, 5), (3, 1, "X-1", 1), (4, 1, "X-1", None), (5, 1, "R-5", 3), (5, 2, "Q-1 2 OF 3", 3)]
    answers = [(1, "so [s2], see c-3", "a-1"), (2, "[S2][S9]", None), (3, None, "s-9"), (4, "", ""), (5, "[S7] r-5 and q-1 2 of 3", "S-9"), (7, "[S1]", None)]
    figures, hits = spark.createDataFrame(figures, FIGURES), spark.createDataFrame(hits, HITS)
    answers = spark.createDataFrame(answers, "query_id int, answer string, seed_code string")

    def shown(most):
        out = {}
        for r in I.shown_figures(figures, hits, answers, most).orderBy("position").collect():
            out.setdefault(r["query_id"], []).append((r["figure"], r["tier"]))
        return out

    two = {1: [("f2", "cited"), ("f3", "page")], 2: [("g2", "hit")], 3: [("h2", "seed")], 4: [("i0", "first")], 5: [("j1", "cited"), ("j2", "cited")]}
    assert shown(2) == two
    assert shown(1) == {q: f[:1] for q, f in two.items()}
    more = shown(4)
    assert more[1] == [("f2", "cited"), ("f3", "page"), ("f1", "beside")] and more[5] == [("j1", "cited"), ("j2", "cited"), ("j4", "cited"), ("j3", "beside")]
    assert I.shown_figures(figures.limit(0), hits, answers).count() == 0
    assert {r["figure"]: r["tier"] for r in I.shown_figures(figures, hits.limit(0), answers).filter("query_id = 2").collect()} == {"g1": "first"}

    told = {r["figure"]: r["source_index"] for r in I.with_source_index(figures.filter("figure <> 'h2'"), hits).collect()}
    assert told == {"f1": 1, "f2": 2, "f3": None, "g1": None, "g2": 2, "g3": None, "h1": 1, "i1": None, "i0": 1, "j1": 1, "j2": 7, "j3": None, "j4": 2, "k1": None}
    kept = spark.createDataFrame([(1, 2, 1), (5, 7, 2)], "query_id int, rank int, new_rank int")
    new = I.with_new_index(figures, kept)
    assert new.columns == figures.columns
    assert {r["figure"]: r["source_index"] for r in new.filter("source_index is not null").collect()} == {"f2": 1, "j2": 2}


def test_words_to_grid(spark):
    words = [(1, i, 10.0 + dx, float(y), t) for i, (dx, y, t) in enumerate([(0, 0, "a"), (300, 1, "b"), (5, 20, "c"), (12, 20, "d"), (302, 22, "e"), (150, 40, "f"), (0, 41, " g "), (301, 41, "h")])]
    words += [(1, 90, 10.0, 0.0, "  "), (1, 91, None, 0.0, "x"), (1, 92, 5.0, 5.0, None), (None, 93, 5.0, 5.0, "x")]
    words += [(2, i, 1.0, float(i * 20), "w") for i in range(20)] + [(3, i, i * 100.0, 0.0, "w") for i in range(7)]
    words = spark.createDataFrame(words, "page int, word_id int, x0 double, y0 double, text string").repartition(3)
    assert [tuple(r) for r in W.word_grid(words).collect()] == [(1, [["a", "", "b"], ["c d", "", "e"], ["g", "f", "h"]])]
    assert W.word_grid(words.limit(0)).count() == 0


def test_kinds_of_grids(spark):
    long = "x" * 45
    grids = {
        "two": [["a", "b"], ["c", "d"]], "one_row": [["a", "b"]], "column": [["a"], ["b"]], "labels": [["[A]"], ["[B] x"]], "head": [["I 级 推荐"], ["x"]], "blank": [["", " "], [None, ""]],
        "note": [["【注释】", ""], ["a", "b"]], "prose": [[long, long], [long, long]], "regimens": [["[A]", long, long], ["[ B ]", long, long], [long, long, long]],
        "refs": [["Smith et al", "2001"], ["see 2002, 2003", "doi"]], "authors": [["SMITH J, DOE A, ROE B"], ["[1] [2] [3]"]], "empty": [], "null": None,
    }
    frame = spark.createDataFrame(list(grids.items()), "name string, grid array<array<string>>")
    rows = frame.select("name", W.is_table(F.col("grid")).alias("t"), W.is_note_grid(F.col("grid")).alias("n"), W.is_reference_grid(F.col("grid")).alias("r")).collect()
    assert {r["name"] for r in rows if r["t"]} == {"two", "labels", "head", "regimens", "refs"}
    assert {r["name"] for r in rows if r["n"]} == {"note", "prose"}
    assert {r["name"] for r in rows if r["r"]} == {"refs", "authors"}
    assert not [r for r in rows if None in tuple(r)]
    texts = [("", True), (None, True), ("no end", True), ("n" * 400, False), ("a。", False), ("分层 a。", True), ("分层 a。b。", False)]
    got = spark.createDataFrame([(t, w) for t, w in texts], "text string, want boolean").select("want", W.is_reflow(F.col("text")).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got)


def test_titles_in_capitals_lead_back_to_their_lines(spark, tmp_path):
    texts = ["große straße\nx", "große straße\ny", "ŉ ﬁn\nz"]
    rows = [(i, t, "en", "src", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["chapter"]: (r["title"], r["told_by"]) for r in V.chapter_labels(spark, str(tmp_path)).collect()}
    assert got == {0: ("GROẞE STRAẞE", "contents"), 1: ("GROẞE STRAẞE", "contents"), 2: ("ŉ ﬁN", "contents")}


def test_rows_of_pages_are_streamed(spark):
    random.seed(8)
    words = [(p, i, float(random.randrange(0, 300, 30)), random.random() * 60) for p in (None, 1, 2, 3) for i in range(50)] + [(4, 0, 1.0, None), (4, 1, 0.0, 3.0)]
    frame = spark.createDataFrame(words, "page int, word_id int, x0 double, y0 double").repartition(3)
    want = {}
    for p in (None, 1, 2, 3):
        row, height = 0, None
        for _, x, i, y in sorted((round(y / 8.0) * 8.0, x, i, y) for q, i, x, y in words if q == p):
            if height is not None and abs(y - height) > 8.0:
                row, height = row + 1, y
            height = y if height is None else (height + y) / 2
            want[p, i] = row
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        rows = L.row_groups(frame)
        got = {(r["page"], r["word_id"]): r["row"] for r in rows.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want | {(4, 1): 0, (4, 0): 1}
    # Whole pages don't become frames in Python, one by one.
    assert "FlatMapGroupsInPandas" not in rows._jdf.queryExecution().toString()
