"""Near-duplicate texts and vectors, language model and pipeline against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import blocks, class_lm, embedding_dedup, near_join
from quarry.llm.queries import QUERIES


def linked(items, near):
    """Direct links and smallest member of the component, by trying every pair."""
    root = {i: i for i, _ in items}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = Counter()
    for k, (i, x) in enumerate(items):
        for j, y in items[:k]:
            if near(x, y):
                n[i] += 1
                n[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (find(i), n[i]) for i, _ in items}


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return bool(a and b) and len(a & b) >= 0.8 * len(a | b) - 1e-12


def near_texts():
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    texts = []
    for size in (5, 30, 120, 400):
        for _ in range(4):
            base = rng.choices(words, k=size)
            for change in (0, 0, 1, 2, 5):
                w = list(base)
                for _ in range(change * size // 100):
                    w[rng.randrange(size)] = rng.choice(words)
                texts.append(" ".join(w))
    base = rng.choices(words, k=150)  # a large group of near copies
    for k in range(90):
        w = list(base)
        w[k] = f"x{k}"
        texts.append(" ".join(w))
    texts += ["One two", "one  TWO", "", None, "   ", "solo", "z " * 40_000]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_prefixes_are_shortened_to_the_recall():
    assert near_join.floor_depth(0.8, 24, 10, 0.999) == 6
    assert near_join.found(0.8, 7, 24) < 0.999 <= near_join.found(0.8, 6, 24)
    with pytest.raises(ValueError):
        near_join.floor_depth(0.1, 2, 10, 0.999)


def met_pairs(floors, packed, herd, buckets):
    """Where ``_meet`` finds each pair of rows; none may come twice."""
    got = {}
    lists = lambda m: pa.array(m.tolist(), pa.list_(pa.int64()))
    for bucket, rows in buckets:
        for bi, bj in ((0, 0), (0, 1), (1, 1)):
            part = rows[np.isin(rows % 2, (bi, bj))]
            n = len(part)
            if not n:
                continue
            numbers = [pa.array([bucket] * n, pa.int64()), pa.array([bi] * n, pa.int32()), pa.array([bj] * n, pa.int32()), pa.array(part % 2, pa.int32())]
            group = pa.table([*numbers, lists(floors[part]), lists(packed[part]), pa.array([herd[k] for k in part], pa.int64())], ["bucket", "bi", "bj", "mine", "floors", "above", "herd"])
            for i, j in zip(*near_join._meet(group), strict=True):
                key = tuple(sorted((int(part[i]), int(part[j]))))
                assert key not in got
                got[key] = bucket
    return got


def test_a_pair_belongs_to_one_tree_the_deepest_or_to_its_herd():
    rng = np.random.default_rng(1)
    floors = rng.integers(0, 3, (60, 5)) + 10 * np.arange(5)
    above = rng.integers(0, 2, (60, 5, near_join.LEVELS), dtype=np.int64)
    packed = (above << np.array([48, 32, 16, 0])).sum(2)
    level = lambda i, j, t: -1 if floors[i, t] != floors[j, t] else int(np.cumprod(above[i, t] == above[j, t]).sum())
    want = {}
    for i in range(60):
        for j in range(i):
            deep, tree = max((level(i, j, t), -t) for t in range(5))
            if deep >= 0:
                want[j, i] = int(floors[i, -tree])
    buckets = [(b, np.flatnonzero((floors == b).any(1))) for b in np.unique(floors).tolist()]
    assert met_pairs(floors, packed, [None] * 60, buckets) == want
    # All rows with a floor of 0 in the first tree are a herd in place of that bucket.
    herd = [0 if f == 0 else None for f in floors[:, 0].tolist()]
    inside = {k for k in range(60) if herd[k] == 0}
    assert met_pairs(floors, packed, herd, buckets) == {(i, j): 0 if {i, j} <= inside else b for (i, j), b in want.items()}


def jaccard_pair(rng, apart):
    """Two texts of 200 different shingles each whose sets share so many that the similarity is 0.8 or little more."""
    words = [f"v{rng.randrange(10**9)}" for _ in range(204)]
    other = list(words)
    for k in range(apart):  # each new word near an end takes few shingles
        other[k] = f"u{rng.randrange(10**9)}"
    return " ".join(words), " ".join(other)


@pytest.mark.parametrize("beside", [False, True])
def test_pairs_that_share_only_a_short_prefix_are_found(spark, beside):
    """Also where no pair shares a longer one, or only much nearer pairs do."""
    rng = random.Random(5)
    floor = near_join.floor_depth()
    forest = near_join.Forest(near_join.TREES, floor)
    pairs = []
    while len(pairs) < 6:
        a, b = jaccard_pair(rng, rng.choice((16, 18, 21)))
        (fa, da), (fb, db) = (forest.labels(near_join.shingles(t)) for t in (a, b))
        if (fa == fb).any() and not ((fa == fb) & (da == db)).any():
            pairs.append((a, b))
    for a, b in pairs[: 1 if not beside else None]:
        like = len(shingle_set(a) & shingle_set(b)) / len(shingle_set(a) | shingle_set(b))
        assert 0.8 <= like <= 0.86
        rows = [(1, a), (2, b)] + [(10 + k, f"{pairs[0][0]} {k}") for k in range(4) if beside and a != pairs[0][0]]
        got = {r["doc_id"]: r["n_links"] for r in near_join.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got[1] == got[2] == 1 and (len(rows) == 2 or got[10] == 3)


def test_herds_take_large_groups_together(spark):
    """Near copies share most of their groups; two families that share none stay apart, small groups are left."""
    rows = [(f"{f}{k}".encode(), 10, 100 * f + t) for f in (1, 2) for k in range(40) for t in range(6) if (k + t) % 4] + [(b"x", 10, 7), (b"y", 10, 7)]
    members = spark.createDataFrame([(bytes(a), b, c) for a, b, c in rows], "set binary, n_chars long, bucket long")
    docs, replaced = near_join.herds(members, 8)
    assert {r["bucket"] for r in replaced.collect()} == {100 * f + t for f in (1, 2) for t in range(6)}
    assert sorted((bytes(r["set"]), r["herd"]) for r in docs.collect()) == sorted({(s, 100 * int(s[:1])) for s, _, b in rows if b != 7})
    assert near_join.herds(members, 1000) is None
    one = members.filter("bucket = 100")  # a single large group gains nothing
    assert near_join.herds(one, 8)[0].count() == 0


@pytest.mark.parametrize("block", [1024, 20])
def test_near_groups_equal_all_pairs(spark, block):
    docs = near_texts()
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, class_id string, rep int")
    want = linked([(i, shingle_set(t)) for i, t in docs], jaccard)
    got = {r["doc_id"]: r for r in near_join.near_groups(frame, block=block).collect()}
    assert {i: (r["class_id"], r["n_links"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["doc_id"] == r["class_id"]) for r in got.values())
    if block == 1024:
        kept = near_join.drop_near(frame)
        assert kept.columns == frame.columns
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted({c for c, _ in want.values()})


def test_near_groups_of_nothing_and_without_ids(spark):
    schema = "doc_id long, text string"
    assert near_join.near_groups(spark.createDataFrame([], schema)).count() == 0
    rows = near_join.near_groups(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (5, None)], schema)).collect()
    assert sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"], r["kept"]) for r in rows) == [(0, 0, 0, True), (4, 4, 1, True), (4, 4, 1, True), (5, 5, 0, True)]
    kept = near_join.drop_near(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (4, "a b c"), (5, None)], schema)).collect()
    assert sorted((r["doc_id"] or 0) for r in kept) == [0, 4, 5]


def test_one_id_on_different_texts_and_clashing_names(spark):
    """Links and groups go by texts, not by ids; no row is lost but copies."""
    rng = random.Random(8)
    a, b = (" ".join(rng.choices([f"w{k}" for k in range(300)], k=90)) for _ in range(2))
    docs = [(1, a, 1, "x"), (1, b, 2, "x"), (2, a + " more", 3, None), (3, b + " more", 4, "y"), (4, "alone here", 5, "z"), (4, "also alone", 6, "z"), (None, a, 7, "z"), (None, a, 7, "z"), (3, b + " more", 9, "y")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, row int, set string")
    for name in ("__id", "text_key", "lead", "rest"):
        frame = frame.withColumn(name, F.lit(1))
    got = sorted((r["doc_id"] or 0, r["class_id"] or 0, r["n_links"]) for r in near_join.near_groups(frame).collect())
    assert got == [(0, 0, 0), (0, 0, 0), (1, 1, 1), (1, 1, 2), (2, 1, 1), (3, 1, 2), (3, 1, 2), (4, 4, 0), (4, 4, 0)]
    kept = near_join.drop_near(frame)
    assert kept.columns == frame.columns
    assert sorted(r["row"] for r in kept.collect()) == [1, 2, 5, 6, 7, 7]


def test_links_of_the_table_against_all_pairs(spark):
    """Recall over ``documents``: every pair that shares a shingle is tried."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets, copies, holders = {}, Counter(), {}
    for r in rows:
        if s := frozenset(shingle_set(r["text"])):
            sets[r["doc_id"]] = s
            copies[s] += 1
    classes = list(copies)
    for k, s in enumerate(classes):
        for x in s:
            holders.setdefault(x, []).append(k)
    both = Counter((i, j) for ks in holders.values() for n, j in enumerate(ks) for i in ks[:n])
    links, banded = Counter(), {k: Counter() for k in (80, 85, 90, 95)}
    for (i, j), n in both.items():
        either = len(classes[i]) + len(classes[j]) - n
        if n >= 0.8 * either - 1e-9:
            links[classes[i]] += copies[classes[j]]
            links[classes[j]] += copies[classes[i]]
            banded[min(95, int(100 * n / either + 1e-9) // 5 * 5)][i, j] = 1
    # Recall by similarity: of the pairs of each band, those that share a prefix in some tree.
    forest = near_join.Forest(near_join.TREES, near_join.floor_depth())
    text = {sets[r["doc_id"]]: r["text"] for r in rows if r["doc_id"] in sets}
    floors = [forest.labels(near_join.shingles(text[s]))[0] for s in classes]
    for band, pairs in banded.items():
        met = sum((floors[i] == floors[j]).any() for i, j in pairs)
        assert met >= 0.99 * len(pairs), (band, met, len(pairs))
    want = {i: links[s] + copies[s] - 1 for i, s in sets.items()}
    got = {r["doc_id"]: r["n_links"] for r in near_join.near_groups(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert all(got[i] <= n for i, n in want.items()) and sum(got.values()) >= 0.99 * sum(want.values())


def test_components_of_paths_and_stars(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 200), (7, 7)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["component"] for r in blocks.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 130)} | {200: 200, 201: 200}
    assert blocks.components(spark.createDataFrame([], "a long, b long")).count() == 0


# vectors


def test_near_vectors_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    more = []
    for cos in (0.9001, 0.92, 0.97, 0.999, 0.8999):
        for v in x[:40]:
            aside = rng.standard_normal(32)
            aside -= (aside @ v) * v
            more.append(cos * v + math.sqrt(1 - cos * cos) * aside / np.linalg.norm(aside))
    hub = [x[0] + 0.02 * rng.standard_normal(32) for _ in range(150)]
    vectors = [*x, *more, *hub, x[5], x[5] * 3, np.zeros(32)]
    items = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    odd = [(9000, None), (9001, []), (9002, [math.nan] * 32), (9003, [1.0, None] + [0.0] * 30), (9004, [math.inf] + [0.0] * 31), (9005, [1.0, 2.0])]  # the only one of its length
    frame = spark.createDataFrame([(i, v, 0, 1) for i, v in items + odd], "vec_id long, embedding array<double>, copies int, rep int")

    def unit(v):
        v = np.array(v)
        return v / np.linalg.norm(v) if np.any(v) else None

    want = linked([(i, unit(v)) for i, v in items], lambda a, b: a is not None and b is not None and float(a @ b) >= 0.9)
    got = {r["vec_id"]: (r["component_id"], r["n_links"]) for r in embedding_dedup.near_vectors(frame, block=64).collect()}
    assert all(got[i] == (i, 0) for i, _ in odd) and got.keys() == want.keys() | {i for i, _ in odd}
    found, all_ = sum(n for i, (_, n) in got.items() if i < 9000), sum(n for _, n in want.values())
    assert all_ * 0.99 <= found <= all_
    assert all(got[i][1] <= want[i][1] for i in want)


def test_one_vector_id_on_different_vectors_and_lengths(spark):
    e = np.eye(6)
    rows = [(1, e[0]), (1, e[1]), (2, e[0] + 0.1 * e[2]), (3, e[1] + 0.1 * e[3]), (4, np.ones(3)), (5, np.ones(3) * 2 + 0.01 * e[0][:3]), (6, e[4])]
    frame = spark.createDataFrame([(i, [float(x) for x in v], 1, 2) for i, v in rows], "vec_id long, embedding array<double>, key int, lead int")
    got = sorted((r["vec_id"], r["component_id"], r["n_links"]) for r in embedding_dedup.near_vectors(frame).collect())
    assert got == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 4, 1), (5, 4, 1), (6, 6, 0)]


def test_ties_go_one_way_in_any_block():
    rng = np.random.default_rng(2)
    v = rng.standard_normal((40, 24))
    x = embedding_dedup.unit(v.tolist())
    exact = float((x[3] * x[7]).sum())
    for some in (np.arange(40), np.array([3, 7]), np.array([7, 3, 1])):
        part = embedding_dedup._linked(x[some], np.ones((len(some),) * 2, bool), exact)
        assert part[list(some).index(3), list(some).index(7)]


def test_links_of_the_vectors_against_all_pairs(spark):
    """Recall over ``embeddings``, by trying every pair."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    x = np.array([r["embedding"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = dict(zip((r["vec_id"] for r in rows), (x @ x.T >= 0.9).sum(1) - 1, strict=True))
    got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(table).collect()}
    assert all(got[i] <= n for i, n in want.items()) and sum(got.values()) >= 0.99 * sum(want.values())


def test_near_vectors_of_nothing(spark):
    schema = "vec_id long, embedding array<float>"
    assert embedding_dedup.near_vectors(spark.createDataFrame([], schema)).count() == 0
    one = embedding_dedup.near_vectors(spark.createDataFrame([(3, [1.0, 0.0]), (3, [1.0, 0.0]), (None, [1.0, 0.0])], schema)).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"]) for r in one) == [(0, 0), (3, 1), (3, 1)]


@pytest.mark.parametrize("dims, n", [(64, 134_000_000), (32, 134_000_000), (64, 10_000)])
def test_tables_of_any_number_of_vectors_reach_the_recall(dims, n):
    rng = np.random.default_rng(8)
    x, aside = rng.standard_normal((2, 4000, dims))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = embedding_dedup.fit(x[:2000], n)
    aside -= (aside * x).sum(1, keepdims=True) * x
    y = 0.9 * x + math.sqrt(1 - 0.81) * aside / np.linalg.norm(aside, axis=1, keepdims=True)
    met = (index.keys(index.codes(x[2000:])) == index.keys(index.codes(y[2000:]))).any(1)
    assert met.mean() > 0.985


def test_where_tables_miss_the_recall_one_bucket_holds_all(monkeypatch):
    monkeypatch.setattr(embedding_dedup, "MAX_ROTATIONS", 2)
    index = embedding_dedup.fit(np.eye(8), 1000, recall=1.01)
    assert (index.tables, index.bits, index.near) == (1, 0, 8) and set(index.keys(index.codes(np.eye(8))).ravel()) == {0}
    assert embedding_dedup.fit(np.array([[1.0], [1.0], [-1.0]]), 300).tables


# language model


def test_scores_on_the_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    counts = Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update([*class_lm.tokens(t), b""])
    n, v = sum(counts.values()), len(counts)
    rows = QUERIES["op7_class_lm"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    texts = dict(docs)
    for r in rows:
        t = [*class_lm.tokens(texts[r["doc_id"]]), b""]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1, len(t), sum(counts[w] > 0 for w in t), n)
        assert math.isclose(r["base_score"], sum(math.log10((counts[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def brute_model(docs, classes, words, suffixes):
    """The model by plain loops: log10 probability of a text, and of a word in a class, transitions."""
    texts = [[*class_lm.tokens(t), b""] for i, t in docs if zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for t in texts for w in t)
    ranked = sorted((w for w in counts if w), key=lambda w: (-counts[w], w))
    ends = Counter()
    for w in ranked[words:]:
        ends[w[-3:]] += counts[w]
    ends = sorted(ends, key=lambda e: (-ends[e], e))[:suffixes]
    own = ranked[:words]
    size = len(own) + len(ends) + 2
    unit = lambda w: 0 if not w else own.index(w) + 1 if w in own else len(own) + 1 + ends.index(w[-3:]) if w[-3:] in ends else size - 1
    pairs = Counter((unit(a), unit(b)) for t in texts for a, b in zip([b"", *t], t, strict=False))
    left, right, n = (np.array(x) for x in zip(*((a, b, float(n)) for (a, b), n in sorted(pairs.items())), strict=True))
    cls = class_lm.exchange(left, right, n, size, classes)
    k = int(cls.max()) + 1
    table = np.bincount(cls[left] * k + cls[right], n, k * k).reshape(k, k)
    of = {w: int(cls[unit(w)]) for w in [b"", *own]}
    for w in ranked[words:]:
        cells = np.zeros(2 * k + 1, np.int64)
        for t in texts:
            for x, now, y in zip([b"", *t], t, [*t[1:], b""], strict=False):
                if now == w:
                    cells[cls[unit(y)]] += 1
                    cells[k + cls[unit(x)]] += 1
                    cells[2 * k] += x == w
        of[w] = int(class_lm.best_classes(cells[None], cls[[unit(w)]], table)[0])
    n1, n2 = (sum(n == k for n in counts.values()) for k in (1, 2))
    cut = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    inside, types, one, two, three = Counter(), Counter(of.values()), Counter(), Counter(), Counter()
    for t in texts:
        c = [0, 0, *(of[w] for w in t)]
        inside.update(c[2:])
        one.update(c[2:])
        two.update(zip(c[1:], c[2:], strict=False))
        three.update(zip(c, c[1:], c[2:], strict=False))

    def step(a, b, c):
        p = (one[c] + 0.5) / (sum(one.values()) + 0.5 * k)
        p = (two[b, c] + 20 * p) / (sum(two[b, x] for x in range(k)) + 20)
        return (three[a, b, c] + 50 * p) / (sum(three[a, b, x] for x in range(k)) + 50)

    def word(w, c):
        if not w:
            return 1.0
        return (counts[w] - cut) / inside[c] if w in counts else max(cut * types[c], 0.5) / inside[c]

    def score(text):
        total, history = 0.0, (0, 0)
        for w in [*class_lm.tokens(text), b""]:
            c = of.get(w, int(cls[unit(w)]))
            total += math.log10(step(*history, c) * word(w, c))
            history = (history[1], c)
        return total

    mass = {c: sum(word(w, c) for w, x in of.items() if x == c) + (max(cut * types[c], 0.5) / inside[c] if c else 0) for c in range(k)}
    return score, step, mass, k


def test_scores_equal_plain_loops_and_sum_to_one(spark):
    rng = random.Random(4)
    docs = [(k, " ".join(rng.choices(["a", "b", "c,", "dog", "cat", "frog", "hog", "log", f"u{k % 7}x", f"v{k}y"], k=12))) for k in range(90)]
    docs += [(200, ""), (201, None), (202, "zzq a dog"), (203, "a a a a"), (203, "a a a a"), (203, "b zz")]
    options = {"classes": 4, "words": 3, "suffixes": 2}
    score, step, mass, k = brute_model(docs, **options)
    for lookup in (5, 1000):
        rows = class_lm.score_texts(spark.createDataFrame(docs, "doc_id long, text string"), lookup=lookup, **options).collect()
        assert np.allclose(sorted((r["doc_id"], r["score"]) for r in rows), sorted((i, score(t)) for i, t in docs))
    for a in range(k):
        for b in range(k):
            assert math.isclose(sum(step(a, b, c) * mass[c] for c in range(k)), 1)


@pytest.mark.parametrize("lookup", [5, 100])
def test_known_words_of_one_ending_have_classes_of_their_own(spark, lookup):
    rng = random.Random(6)
    nouns, verbs = [f"n{k}ing" for k in range(12)], [f"v{k}ing" for k in range(12)]
    say = lambda: f"the {rng.choice(nouns)} did {rng.choice(verbs)}"
    docs = [(i, " ".join(say() for _ in range(6))) for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1]
    held = [i for i in range(400, 600) if zlib.crc32(str(i).encode()) % 5 == 1]
    asked = [(held[0], "the n3ing did v5ing"), (held[1], "the v5ing did n3ing")]
    # Some words of either kind are units, so classes for both are there.
    frame = spark.createDataFrame(docs + asked, "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in class_lm.score_texts(frame, classes=5, words=8, suffixes=2, lookup=lookup).collect()}
    assert got[held[0]] > got[held[1]] + 1


def test_best_classes_raise_the_likelihood_most():
    rng = np.random.default_rng(7)
    cls = np.array([0, 1, 1, 2, 2, 3, 3, 1, 2, 3])
    text = rng.integers(1, 10, 400)
    text[rng.integers(0, 400, 40)] = 0
    text = np.append(text, 0)
    before, k = np.append(0, text[:-1]), 4

    def table(cls):
        return np.bincount(cls[before] * k + cls[text], minlength=k * k).reshape(k, k).astype(float)

    def likelihood(cls):
        t = table(cls)
        return class_lm._h(t).sum() - class_lm._h(t.sum(1)).sum() - class_lm._h(t.sum(0)).sum()

    for w in range(1, 10):
        at = np.flatnonzero(text == w)
        own = (before[at] == w).sum()
        cells = np.concatenate([np.bincount(cls[text[at + 1]], minlength=k), np.bincount(cls[before[at]], minlength=k), [own]])
        moved = [likelihood(np.where(np.arange(10) == w, b, cls)) for b in range(1, k)]
        assert class_lm.best_classes(cells[None], cls[[w]], table(cls))[0] == 1 + int(np.argmax(moved))


def test_exchange_finds_the_groups():
    rng = np.random.default_rng(0)
    left, right, n = [], [], []
    for u in range(1, 41):
        for _ in range(200):
            v = int(rng.integers(1, 21)) + (0 if u > 20 else 20)  # the halves follow each other
            left.append(u)
            right.append(v)
            n.append(1.0)
    cls = class_lm.exchange(np.array(left), np.array(right), np.array(n), 41, 3)
    assert len(set(cls[1:21])) == len(set(cls[21:])) == 1 and cls[1] != cls[40] and cls[0] == 0


def test_scores_of_nothing_and_odd_rows(spark):
    schema = "doc_id long, text string, base double"
    assert class_lm.score_texts(spark.createDataFrame([], schema)).count() == 0
    rows = class_lm.score_texts(spark.createDataFrame([(1, None, 1.0), (1, None, 1.0), (2, "", 1.0), (None, "a a b", 1.0), (None, "a a b", 1.0)], schema)).collect()
    assert len(rows) == 5 and all(math.isfinite(r["score"]) for r in rows)
    assert sorted(r["n_tokens"] for r in rows) == [1, 1, 1, 4, 4]
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1]
    only = class_lm.score_texts(spark.createDataFrame([(held[0], "never seen", 1.0)], schema)).first()
    assert only["n_known"] == 0 and only["score"] == only["base_score"]


# pipeline


def test_pipeline_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, docs.count()
    extra = docs.limit(3).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    docs = docs.unionByName(extra)  # exact copies under other ids
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == columns, name
        n = docs.count()
        assert 0 < n <= before + 3
    assert docs.filter("doc_id >= 1000000").count() == 0
    mixed = corpus_pipeline.STAGES[3][1](spark, docs, sf_dir)
    assert mixed.columns == columns and mixed.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 3
    assert corpus_pipeline.STAGES[4][1](spark, mixed, sf_dir).count() == mixed.count()


EXTRA = ("row", "score", "n_words", "hits", "set", "text_key", "lead", "rest", "size", "draw", "start", "__id", "__text", "i", "t")


@pytest.mark.parametrize("empty", [False, True])
def test_pipeline_stages_take_odd_rows(spark, empty):
    """Nulls, repeated rows and ids, rows without words and clashing names in every stage; and no rows at all."""
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    passage = spark.read.parquet(f"{sf_dir}/benchmark.parquet").filter("length(text) > 80").first()["text"]
    odd = [(None, "no id here", "en", None, 1), (9001, None, None, None, None), (9002, "", "en", "src1", 0), (9003, " \n ", "en", "src1", 3)]
    odd += [(9004, "same id, this text", "en", "src2", 1), (9004, "same id but another text", "en", "src2", 1), (9005, "word " * 50_000, "en", "src2", 1), (9006, f"x {passage} y", "en", "src2", 1)] + [(9007, "a repeated row", "de", "src3", 1)] * 2
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    for name in EXTRA:
        docs = docs.withColumn(name, F.lit(1))
    docs = docs.limit(0) if empty else docs
    stages = dict(corpus_pipeline.STAGES)
    kept = {}
    for name in list(stages)[:4]:
        out = stages[name](spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        kept[name] = Counter(r["text"] for r in out.filter("doc_id > 9000 or doc_id is null").collect())
    n = stages["token_output"](spark, docs, sf_dir).count()
    if empty:
        assert n == 0 and not any(kept.values())
        return
    assert n == 40
    assert kept["ngram_jaccard_join"] == Counter({t for _, t, *_ in odd})  # of the repeated row, one
    assert kept["benchmark_decontamination"] == Counter(t for i, t, *_ in odd if i != 9006)
