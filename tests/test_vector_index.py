"""The stored vector index beside an exact scan."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.operators import search as S
from quarry.operators import vector_index as V


def rows_of(frame):
    return sorted(tuple(r) for r in frame.select("query_id", "doc_id", "score", "rank").collect())


def scored_join(found):
    """The join of questions with blocks in the last step of the search that makes ``found``, once it has run."""
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return re.search(r"MapInArrow best\(.*?(\w+Join)\b", plan, re.DOTALL)[1]


@pytest.fixture(scope="module")
def clusters(spark):
    """Twenty tight clusters of very different sizes, one vector many times over, and odd rows."""
    random = np.random.default_rng(5)
    centers = random.normal(size=(20, 16))
    rows = []
    for c in range(20):
        for _ in range(600 if c == 0 else 40):
            rows.append((len(rows), (centers[c] + 0.05 * random.normal(size=16)).tolist()))
    rows += [(len(rows) + i, centers[3].tolist()) for i in range(300)]
    odd = [(10_000, None), (10_001, [0.0] * 16), (10_002, [1.0]), (10_003, [float("nan")] * 16), (10_004, [None] * 16), (10_005, [float("inf")] + [1.0] * 15), (10_006, [])]
    good = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return good, good.unionByName(spark.createDataFrame(odd, good.schema))


@pytest.fixture(scope="module")
def asked(clusters):
    return clusters[0].filter("vec_id % 37 = 0").selectExpr("vec_id AS query_id", "embedding AS vector")


def test_add_delete_and_add_again(spark, clusters, asked, tmp_path):
    good, every = clusters
    index = V.VectorIndex(spark, f"file://{tmp_path}/v")
    assert index.search(asked, 5).count() == 0 and index.probed(asked, 5).count() == 0
    assert index.add(every.filter("vec_id < 700")) == 0 and index.add(every.filter("vec_id >= 700")) == 1
    for k in (1, 7, 400, 5000):
        assert rows_of(index.search(asked, k)) == rows_of(S.vector_search(good, asked, k)), k
    index.delete(good.filter("vec_id % 3 = 0").select("vec_id"))
    left = good.filter("vec_id % 3 <> 0")
    assert rows_of(index.search(asked, 7)) == rows_of(S.vector_search(left, asked, 7))
    index.delete(spark.createDataFrame([(1,), (3,), (99999,)], "i long"))
    index.add(good.filter("vec_id in (3, 6)"))
    left = good.filter("vec_id % 3 <> 0 and vec_id <> 1 or vec_id in (3, 6)")
    again = V.VectorIndex(spark, f"file://{tmp_path}/v")
    assert rows_of(again.search(asked, 7)) == rows_of(S.vector_search(left, asked, 7))
    with pytest.raises(ValueError, match="centers"):
        again.learn(good)


def test_most_cells_of_clustered_vectors_are_left_out(spark, clusters, asked, tmp_path):
    index = V.VectorIndex(spark, f"file://{tmp_path}/v")
    index.add(clusters[0])
    cells = len(index.centers())
    read = index.probed(asked, 5).agg({"cells": "avg"}).first()[0]
    assert cells >= 20 and read < cells / 2
    exact, few = (set(r[:2] for r in rows_of(x)) for x in (index.search(asked, 5), index.search(asked, 5, probes=4)))
    assert len(exact & few) >= 0.9 * len(exact)


def test_a_batch_that_was_lost_halfway_has_no_effect(spark, clusters, asked, tmp_path):
    good = clusters[0]
    index = V.VectorIndex(spark, f"file://{tmp_path}/v")
    index.add(good.filter("vec_id < 900"))
    before = rows_of(index.search(asked, 3))
    marked, index._mark = index._mark, lambda *_: (_ for _ in ()).throw(RuntimeError("lost"))
    with pytest.raises(RuntimeError):
        index.add(good.filter("vec_id >= 900"))
    assert rows_of(index.search(asked, 3)) == before
    index._mark = marked
    assert index.add(good.filter("vec_id >= 900")) == 1
    assert rows_of(index.search(asked, 3)) == rows_of(S.vector_search(good, asked, 3))


def test_questions_that_find_nothing_and_blocks_of_one_cell(spark, clusters, tmp_path):
    good = clusters[0]
    index = V.VectorIndex(spark, f"file://{tmp_path}/v")
    index.learn(good, cells=1)
    index.add(good)
    asked = spark.createDataFrame([(1, None), (2, [0.0] * 16), (3, [1.0]), (4, [1.0] + [0.0] * 15), (5, [-1e200] * 16)], "query_id long, vector array<double>")
    rows = rows_of(index.search(asked, 4))
    assert {r[0] for r in rows} == {4, 5} and len(rows) == 8
    assert [r for r in rows if r[0] == 4] == rows_of(S.vector_search(good, asked.filter("query_id = 4"), 4))
    empty = V.VectorIndex(spark, f"file://{tmp_path}/e")
    empty.add(good.limit(0))
    assert empty.search(asked, 3).count() == 0


def test_folders_of_blocks_are_few_however_many_cells(spark, tmp_path):
    vectors = [(i, rng.normal(size=4).tolist()) for rng in [np.random.default_rng(4)] for i in range(900)]
    frame = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    index = V.VectorIndex(spark, f"file://{tmp_path}/few")
    assert index.learn(frame, cells=60) > 32
    index.add(frame)
    assert len(list((tmp_path / "few" / "blocks" / "batch=0").glob("*=*"))) <= 16
    asked = frame.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    best = {r["query_id"]: r["doc_id"] for r in index.search(asked, 3).filter("rank = 1").collect()}
    assert best == {i: i for i in range(0, 900, 50)}


def test_questions_meet_blocks_without_a_broadcast_after_a_deletion(spark, clusters, asked, tmp_path):
    index = V.VectorIndex(spark, f"file://{tmp_path}/v")
    index.add(clusters[0])
    index.delete(clusters[0].filter("vec_id % 3 = 0").select("vec_id"))
    assert scored_join(index.search(asked, 5)) == "SortMergeJoin"


def test_questions_meet_blocks_without_a_broadcast(spark, clusters, asked, tmp_path):
    index = V.VectorIndex(spark, f"file://{tmp_path}/v")
    index.add(clusters[0])
    assert scored_join(index.search(asked, 5)) == "SortMergeJoin"
    assert rows_of(index.search(asked, 5)) == rows_of(S.vector_search(clusters[0], asked, 5))
