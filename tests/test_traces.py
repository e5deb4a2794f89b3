"""Traces of answers, triples that may ground them, names of chapters, and levels in other frameworks."""

import pytest
from pyspark.sql import functions as F

from quarry.operators import chapters as H
from quarry.operators import molecular as M
from quarry.operators import traces as T


def test_traces_of_hits_and_steps(spark):
    asked = spark.createDataFrame([(1, "Drug dose", ["drug DOSE of it", "a five-year dose"]), (2, "none", []), (3, None, None)], "query_id int, query string, searches array<string>")
    assert {r["query_id"]: r["k"] for r in asked.select("query_id", T.keywords(F.col("searches")).alias("k")).collect()} == {1: ["drug", "DOSE", "five", "year", "dose"], 2: [], 3: []}
    text = "Start here.\n\n  \n\nThe drug works. The drug dose is 5."
    hits = spark.createDataFrame([(1, 10, 2, 0.5, text), (1, 11, 1, None, None), (2, 12, 1, 1.0, "One. Two."), (9, 13, 1, 1.0, text)], "query_id int, source_id int, rank int, score double, text string")
    rows = {r["source_id"]: tuple(r)[3:] for r in T.evidence_trace(hits, asked).collect()}
    assert rows == {10: ("The drug dose is 5.", 1, ["drug", "DOSE", "dose"], 0.5), 11: ("", 0, [], 0.0), 12: ("One.", 0, [], 1.0)}
    long = T.evidence_trace(spark.createDataFrame([(2, 1, 1, 1.0, "w" * 5000)], hits.schema), asked).first()
    assert len(long["matched_sentence"]) == 260 and long["paragraph_index"] == 0
    triples = spark.createDataFrame([(1, 2, "b", "s", "r", "o", 0.1), (1, 1, "a", "s", "r", "o", 0.2)], "query_id int, rank int, triple_id string, subject_name string, relation string, object_name string, confidence double")
    out = {r["query_id"]: r for r in T.reasoning_trace(asked, hits, triples).collect()}
    assert [e["source_id"] for e in out[1]["evidence"]] == [11, 10] and [s["triple_id"] for s in out[1]["steps"]] == ["a", "b"]
    assert (out[3]["evidence"], out[3]["steps"], out[3]["evidence_count"], out[3]["step_count"]) == ([], [], 0, 0)
    assert T.reasoning_trace(asked, hits.limit(0), triples.limit(0)).count() == 3


@pytest.mark.parametrize(
    "triple,kept",
    [
        (("t", "drug x", "lymphoma", "trusted", None, ["disc-a1-p1-c2"]), True),
        (("t", "drug x", "lymphoma", "trusted", None, ["disc-b1-p1-c2", "page-MOD-3"]), True),
        (("t", "drug x", "dose", "trusted", None, ["disc-b1-p1-c2"]), False),  # known to be out of scope, whatever its names
        (("t", "A drug", "y", None, None, ["edge-1"]), True),  # can't be told: a name that the question has
        (("t", "follicular", "y", None, None, None), True),  # or the subject's name
        (("t", "of", "y", None, None, []), False),
        (("synth:t", "drug x", "z", "trusted", None, ["disc-a1-p1-c2"]), False),
        (("fallback:t", "drug x", "z", "trusted", None, ["disc-a1-p1-c2"]), False),
        (("t", "drug x", " ", "trusted", None, ["disc-a1-p1-c2"]), False),
        (("t", None, "z", "trusted", None, ["disc-a1-p1-c2"]), False),
        (("t", "drug x", "z", "fallback", None, ["disc-a1-p1-c2"]), False),
        (("t", "drug x", "z", "trusted", "synthetic", ["disc-a1-p1-c2"]), False),
        ((None, "drug x", "z", "trusted", None, ["disc-a1-p1-c2"]), True),
    ],
)
def test_triples_that_may_ground_an_answer(spark, triple, kept):
    asked = spark.createDataFrame([(1, "Which DRUG of all", ["a1"], ["MOD"], ["Follicular"]), (2, None, None, None, None)], "query_id int, query string, articles array<string>, modules array<string>, terms array<string>")
    kind = "query_id int, triple_id string, subject_name string, object_name string, validation_status string, review_status string, evidence_source_ids array<string>"
    rows = spark.createDataFrame([(1, *triple)], kind)
    got = T.prompt_triples(rows, asked)
    assert got.columns == rows.columns and got.count() == kept


def test_names_of_chapters(spark):
    rows = [
        ("b", 1, ["x", "  MANTLE  cell "], "Other"), ("b", 2, ["Second Part", "mantle cell"], "h"), ("b", 3, [], "Follicular Lymphoma!"), ("b", 4, None, "Free: Title"), ("b", 5, ["", None], " "), ("b", 6, ["mantle cell and more"], None),
        ("c", 1, ["mantle cell"], "字"), (None, 9, ["mantle cell"], None),
    ]
    chapters = spark.createDataFrame(rows, "doc_id string, chapter int, lines array<string>, heading string")
    contents = spark.createDataFrame([("b", 2, "Mantle Cell"), ("b", 3, "mantle cell"), ("b", 1, "Second part"), ("b", 4, None), (None, 1, "mantle cell")], "doc_id string, at int, title string")
    out = {(r["doc_id"], r["chapter"]): tuple(r)[2:] for r in H.chapter_labels(chapters, contents, [("(?i)mantle", "mcl", "MCL"), ("(?i)lymphoma", "fl", "FL")]).collect()}
    assert out == {
        ("b", 1): ("mcl", "MCL", "contents"), ("b", 2): ("second-part", "Second part", "contents"), ("b", 3): ("fl", "FL", "heading"), ("b", 4): ("free-title", "Free: Title", "heading"),
        ("b", 5): ("general", "General", "default"), ("b", 6): ("general", "General", "default"), ("c", 1): ("general", "字", "heading"), (None, 9): ("general", "General", "default"),
    }
    assert H.chapter_labels(chapters, contents.limit(0), []).filter("told_by = 'contents'").count() == 0


def test_levels_in_other_frameworks(spark):
    rows = [("L1", "Predictive", None, None), ("l3", "PROGNOSTIC", "civic", None), (None, None, "ClinVar", "Pathogenic"), ("L9", "germline", "clinvar", "Likely pathogenic"), ("L2", "Germline therapy", "CLINVAR", "not benign"), ("L4", "germline", "clinvar", "conflicting"), ("L5", "germline", "clinvar", None)]
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, level string, kind string, provider string, said string")
    got = [tuple(r["f"]) for r in frame.select("i", M.framework_levels(*map(F.col, ("level", "kind", "provider", "said"))).alias("f")).orderBy("i").collect()]
    assert got == [("Tier I", "I-A", None), ("Tier II", "IV", None), ("Tier IV", None, None), ("Tier IV", None, "LP"), ("Tier I/II", "I-B", "B"), ("Tier III", None, "VUS"), ("Tier IV", None, None)]
