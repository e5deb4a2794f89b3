"""The stored index beside a search of the documents, and deep trees."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.operators import citations as C
from quarry.operators import conversations as T
from quarry.operators import index as I
from quarry.operators import search as S
from quarry.operators.index import TextIndex


def plain(spark, docs, asked, k, where=None):
    return sorted(tuple(r) for r in S.bm25_search(docs, asked, k, where).select("query_id", "doc_id", "score", "rank").collect())


def found(index, asked, k, where=None, **more):
    return sorted(tuple(r) for r in index.search(asked, k, where, **more).select("query_id", "doc_id", "score", "rank").collect())


@pytest.fixture(scope="module")
def docs(spark):
    """One common word in all, rarer ones in few, sizes from one word to many."""
    rows = [(i, " ".join(["the"] * (i % 7 + 1) + [f"word{i % 50}"] * (i % 3 + 1) + [f"rare{i % 331}"] + ["pad"] * (i % 90)), "ab"[i % 2]) for i in range(1500)]
    return spark.createDataFrame([*rows, (9000, None, "a"), (9001, "", None)], "doc_id long, text string, kind string").repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([(1, "the word7"), (2, "the rare12 the"), (3, "the"), (4, "nothing"), (5, "word1 word2 rare5 the"), (6, None)], "query_id long, query string")


def test_add_delete_and_add_again(spark, docs, asked, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/i", keep=("kind",), buckets=4)
    assert index.search(asked, 5).count() == 0
    assert index.add(docs.filter("doc_id < 600")) == 0 and index.add(docs.filter("doc_id >= 600")) == 1
    assert found(index, asked, 5) == plain(spark, docs, asked, 5)
    assert found(index, asked, 5, F.col("kind") == "a") == plain(spark, docs, asked, 5, F.col("kind") == "a")
    assert found(index, asked, 2000) == plain(spark, docs, asked, 2000)
    index.delete(spark.createDataFrame([(i,) for i in range(0, 900, 3)] + [(777777,)], "i long"))
    left = docs.filter("doc_id % 3 <> 0 or doc_id >= 900")
    assert found(index, asked, 5) == plain(spark, left, asked, 5)
    again = docs.filter("doc_id = 12").withColumn("text", F.lit("rare12 rare12 new"))
    index.add(again)
    assert found(index, asked, 5) == plain(spark, left.unionByName(again), asked, 5)
    assert index.documents().count() == left.count() + 1
    df = {r["term"]: r["df"] for r in index.frequencies().collect()}
    assert df["the"] == left.filter("text like '%the%'").count() and df["new"] == 1


def test_batches_that_run_again_or_were_lost(spark, docs, asked, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/i", buckets=4)
    for _ in range(2):
        index.add(docs, batch=4)
    lost = spark.createDataFrame([("the", 0, 5, 5, 1, 0)], "term string, block long, doc_id long, size int, tf int, bucket int")
    index._write("postings", 7, lost)  # has no totals
    assert index.batches() == [4] and found(index, asked, 4) == plain(spark, docs, asked, 4)


def test_a_search_reads_its_buckets_and_skips_blocks(spark, docs, asked, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/i", buckets=4)
    index.add(docs)
    one = asked.filter("query_id = 1")
    hits = index.search(one, 3)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert any("bucket" in part[:300] for part in plan.split("PartitionFilters")[1:]) and "index-terms" not in plan
    assert sorted(tuple(r) for r in hits.select("query_id", "doc_id", "score", "rank").collect()) == plain(spark, docs, one, 3)


def shuffled_rows(spark):
    """Rows that stages have written to shuffles so far."""
    jvm = spark.sparkContext._jvm
    none = jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_pairs_of_questions_and_documents_are_never_rows(spark, docs, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/i", buckets=4)
    index.add(docs)
    posts = spark.read.parquet(f"{tmp_path}/i/postings")
    many = spark.createDataFrame([(i, f"the pad word{i}") for i in range(50)], "query_id long, query string")
    before = shuffled_rows(spark)
    assert found(index, many, 3) == plain(spark, docs, many, 3)
    assert shuffled_rows(spark) - before < 20_000  # of 75,000 pairs and more
    sizes = index.documents().agg(F.count("*"), F.sum("size")).first()
    assert posts.filter("term = 'the'").count() < 30 and posts.select(F.explode("posts").alias("p")).agg(F.sum(F.shiftright("p", 7))).first()[0] == sizes[1]


def test_blocks_are_whole_however_their_rows_come(spark):
    rows = [(b, k, n, None, [128 * (n + 1) + at for at in range(k + 1)]) for b in (0, 1) for k in range(4) for n in range(5)]
    rows += [(b, k, -1, 100 * b + 10 * k + at, [128 * 9 + at]) for b in (0, 1) for k in range(4) for at in range(k + 1) if (b, k, at) != (1, 2, 0)]
    schema = pa.schema([("batch", pa.int32()), ("block", pa.int64()), ("number", pa.int32()), ("doc_id", pa.int64()), ("posts", pa.list_(pa.int64()))])
    rows.sort(key=lambda r: r[:2])
    want = sorted((r[3], 9, list(range(5)), [1, 2, 3, 4, 5]) for r in rows if r[2] < 0)
    for step in (1, 3, 7, 1000):
        batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + step], strict=True), schema.types, strict=True)], schema=schema) for i in range(0, len(rows), step)]
        got = [r for b in I._by_document(iter(batches)) for r in b.to_pylist()]
        assert sorted((r["doc_id"], r["size"], r["terms"], r["tf"]) for r in got) == want


def test_deep_trees_take_few_rounds(spark, monkeypatch):
    depth = 3000
    rows = spark.range(depth).select(F.lit(1).alias("conv_id"), "id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.col("id").alias("pos"), F.lit(None).cast("long").alias("active_child_id"))
    staged, stage = [], T.stage
    monkeypatch.setattr(T, "stage", lambda df, name: staged.append(name) or stage(df, name))
    path = {r["id"]: r["depth"] for r in T.active_paths(rows).collect()}
    assert path == {k: k for k in range(depth)} and len(staged) <= 2 + 2 * 12
    ring = spark.createDataFrame([(1, 1, 3), (1, 2, 1), (1, 3, 2)], "conv_id int, id long, parent_id long").withColumn("pos", F.col("id"))
    with pytest.raises(ValueError, match="circle"):
        T.subtrees(ring, ring.filter("id = 1").select("conv_id", F.col("id").alias("head_id")))


def test_windows_grow_to_both_sides(spark):
    texts = [(1, "Aa bb. Key here. Cc dd. Ee ff. Gg."), (2, "Long " * 30 + "end. Key. Next " + "word " * 30 + "."), (3, None), (4, " "), (5, "Key alone")]
    rows = spark.createDataFrame(texts, "i int, t string")
    got = {r["i"]: (r["sentence"], r["window"]) for r in C.sentence_windows(rows, F.col("t"), F.array(F.lit("KEY")), 25).collect()}
    assert got[1] == ("Key here.", "Aa bb. Key here. Cc dd.") and got[3] == got[4] == ("", "") and got[5] == ("Key alone", "Key alone")
    assert got[2][1].startswith("Key. Next word")  # the first neighbour comes in whatever its length
