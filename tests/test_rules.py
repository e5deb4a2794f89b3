"""Rules as tables, chapters of long books, and pages by tiers."""

import random

from quarry.operators import etl as E
from quarry.operators import rules as R
from quarry.operators import scope as P


def test_rules_with_captures_ties_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "First-line R-CHOP, then second line of Drug X 20 mg. FIRST-line"), (2, None), (3, ""), (4, "... !"), (5, "drug x")], "doc_id int, text string")
    rules = spark.createDataFrame(
        [("a", "first-line", "line", 1), ("b", "Second  LINE", "line", None), ("c", "drug", "product", 2), ("d", "drug x", "drug x", 1), ("e", "", "none", 1), ("f", None, "none", 1), ("d", "drug x", "drug x", 1)],
        "rule string, alias string, concept string, capture int",
    )
    met = R.rule_matches(docs, rules)
    rows = sorted(tuple(r) for r in met.select("doc_id", "rule", "at", "n_words", "captured").collect())
    assert rows == [(1, "a", 0, 1, "r-chop"), (1, "a", 10, 1, None), (1, "b", 3, 2, None), (1, "c", 6, 1, "x 20"), (1, "d", 6, 2, "20"), (5, "c", 0, 1, None), (5, "d", 0, 2, None)]
    assert sorted(r["rule"] for r in R.longest_matches(met).collect() if r["doc_id"] == 5) == ["d"]
    found = {(r["doc_id"], r["concept"]): (r["n"], r["first_at"], r["captured"]) for r in R.concepts(met).collect()}
    assert found[1, "line"] == (3, 0, "r-chop") and found[5, "product"] == (1, 0, None)
    assert R.rule_matches(docs.limit(0), rules).count() == 0 and R.rule_matches(docs, rules.limit(0)).count() == 0


def test_ten_thousand_rules_have_the_plan_of_ten(spark):
    docs = spark.createDataFrame([(i, f"word{i} the word{i + 1} the x") for i in range(300)], "doc_id int, text string")
    plans = []
    for n in (10, 10_000):
        rules = spark.range(n).selectExpr("id AS rule", "concat('the word', id) AS alias", "id % 7 AS concept")
        met = R.rule_matches(docs, rules)
        plans.append(len(met._jdf.queryExecution().optimizedPlan().toString().splitlines()))
        assert met.count() == min(n - 1, 300)
    assert plans[0] == plans[1]


def test_chapters_beside_one_pass_over_the_pages(spark):
    random.seed(3)
    pages, want = [], {}
    for book, share in (("a", 0.5), ("b", 0.02), ("c", 0.98)):
        state, chapter = None, 0
        for page in sorted(random.sample(range(3000), 900)):
            kind = "toc" if random.random() < 0.1 else "refs" if random.random() < share else "body"
            if kind == "body" and state != "body":
                chapter += 1
            state = state if kind == "toc" else kind
            pages.append((book, page, kind))
            want[book, page] = None if kind == "toc" else chapter
    frame = spark.createDataFrame(pages, "book string, page long, kind string").repartition(5)
    for stretch in (1, 7, 100, 5000):
        got = {(r["book"], r["page"]): r["chapter"] for r in E.segments(frame, stretch=stretch).collect()}
        assert got == want, stretch
    assert E.segments(frame.limit(0)).count() == 0


def test_pages_asked_for_else_the_first_kind_there_is(spark):
    found = [(1, "p1", 1, "table"), (1, "p2", 2, "guideline"), (1, "p2", 3, "table"), (2, "q1", 1, "guideline"), (2, "q2", 2, "table"), (2, "q3", 3, "table"), (2, "q4", 4, "table"), (3, "r1", 1, "other")]
    found = spark.createDataFrame(found, "query_id int, item string, place int, kind string")
    asked = spark.createDataFrame([(1, "p2", 5), (1, "zz", 1), (1, "p1", 9), (1, "p2", 7), (3, "zz", 1), (4, "p1", 1)], "query_id int, item string, place int")
    rows = lambda most: sorted(tuple(r) for r in P.selected_pages(found, asked, most, ("decision", "table", "guideline")).collect())
    assert rows(3) == [(1, "p1", "table", 0, 2), (1, "p2", "guideline", 0, 1), (2, "q2", "table", 2, 1), (2, "q3", "table", 2, 2)]
    assert rows(1) == [(1, "p2", "guideline", 0, 1), (2, "q2", "table", 2, 1)]
