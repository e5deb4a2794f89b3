"""Lexical search beside a plain loop: blocks of questions, ties of copies, scopes, ids of texts."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from quarry.operators import ranking as R
from quarry.operators import search as S


def plain(docs, queries, top_k, can):
    terms = {d: re.findall(r"[a-z][a-z0-9-]+|[0-9]{2,}", (t or "").lower()) for d, t in docs.items()}
    df, mean = Counter(w for ts in terms.values() for w in set(ts)), max(sum(map(len, terms.values())) / len(terms), 1)
    out = set()
    for q, text in queries.items():
        hits = []
        for d, ts in terms.items():
            tf, length = Counter(ts), 0.25 + 0.75 * max(len(ts), 1) / mean
            score = round(sum(math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.5 / (tf[w] + 1.5 * length) for w in set(re.findall(r"[a-z]+", text)) if tf[w]), 6)
            if score > 0 and can(q, d):
                hits.append((-score, d))
        out |= {(q, d, -s, i + 1) for i, (s, d) in enumerate(sorted(hits)[:top_k])}
    return out


def test_search_in_blocks_is_exact_and_stored(spark, monkeypatch):
    random.seed(5)
    words = [a + b for a in "bcd" for b in "aeiou"]
    docs = {f"d{i}": " ".join(random.choices(words, k=random.randint(0, 9))).upper() if i % 9 else None for i in range(300)}
    docs |= {f"copy{i}": "ba be bi bo" for i in range(40)}
    queries = {q: " ".join(random.choices(words + ["zz"], k=random.randint(1, 5))) for q in range(20)} | {20: "", 21: "zz"}
    kinds = {d: (("guide", "other", None)[i % 3], ("m1", "m2", None)[i % 5 % 3], ("a1", "a2")[i % 2]) for i, d in enumerate(docs)}
    frame = spark.createDataFrame([(d, t, *kinds[d]) for d, t in docs.items()], "doc_id string, text string, page_type string, module_code string, article_id string").repartition(3)
    asked = spark.createDataFrame(list(queries.items()), "query_id int, query string")
    monkeypatch.setattr(S, "QUERY_BLOCK_TERMS", 20)
    found = S.bm25_search(frame, asked, 7)
    assert dict(found.dtypes)["query_id"] == "int"
    assert {tuple(r) for r in found.select("query_id", "doc_id", "score", "rank").collect()} == plain(docs, queries, 7, lambda q, d: True)
    # The hits are a table; those who use them twice don't search twice.
    assert found.inputFiles()
    scopes = {q: ([], ["m1"], None)[q % 3] for q in range(21)}
    bound = spark.createDataFrame([(q, m, ["a2"]) for q, m in scopes.items()], "query_id int, modules array<string>, articles array<string>")
    filters = S.MetadataFilters(module_type="guide", article_types=("other",))

    def can(q, d):
        kind, module, article = kinds[d]
        return q in scopes and (kind != "guide" or scopes[q] == [] or module in (scopes[q] or ())) and (kind != "other" or article == "a2")

    found = S.bm25_search(frame, asked, 7, scopes=bound, filters=filters)
    assert {tuple(r) for r in found.select("query_id", "doc_id", "score", "rank").collect()} == plain(docs, queries, 7, can)
    assert S.bm25_search(frame, asked.limit(0), 7).count() == 0
    assert S.bm25_search(frame.limit(0), asked, 7).count() == 0


def test_vector_search_holds_few_scores_at_a_time():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    q, x = rng.integers(-3, 4, (6000, 4)).astype(float) + 0.5, rng.integers(-3, 4, (3000, 4)).astype(float) + 0.5
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    shared = type("Shared", (), {"value": (np.arange(6000), unit(q))})
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(lo, lo + 1500)), pa.array(x[lo : lo + 1500].tolist())], ["id", "v"]) for lo in (0, 1500)]
    tracemalloc.start()
    out = pa.Table.from_batches(S._nearest(shared, 5)(iter(batches)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60_000_000
    s = np.round(unit(q[:50]) @ unit(x).T, 6)
    best = np.lexsort((np.broadcast_to(np.arange(3000), s.shape), -s), axis=1)[:, :5]
    got = {}
    for a, b in zip(out["query_id"].to_pylist(), out["doc_id"].to_pylist(), strict=True):
        got.setdefault(a, []).append(b)
    assert [got[i] for i in range(50)] == best.tolist() and len(out) == 6000 * 5


def test_articles_of_a_question_meet_only_as_its_best(spark):
    rows = [(q, i, f"title {i}", "x beta" if i % 2 else "y", "eng") for q in ("a", None) for i in range(1, 9)] + [("z", 1, "none", "y", "eng")]
    frame = spark.createDataFrame(rows, "query_id string, place int, title string, abstract string, language string")
    none = F.array().cast("array<string>")
    frame = frame.withColumns({"pmid": F.col("place"), "pub_types": none, "mesh": none, "mesh_major": none, "year": F.lit("2020"), "journal_tier": F.lit("T1"), "in_guideline": F.lit(False)})
    ranked = R.rank_articles(frame, R.Concepts(terms=("beta",), biomarkers=("beta",), interventions=(), target_mesh=("m",), target_terms=("t",), competing=(), lines=()), 2026, top_k=3)
    got = sorted((str(r["query_id"]), r["pmid"], r["rank"]) for r in ranked.collect())
    assert got == [("None", 1, 1), ("None", 3, 2), ("None", 5, 3), ("a", 1, 1), ("a", 3, 2), ("a", 5, 3), ("z", 1, 1)]
    assert ranked._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1
