"""Vector codes and clusters against plain loops, packing against the tokenizer."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest

from quarry.llm import packing, vector_clusters, vector_codes
from quarry.llm.queries import tokenizer_path

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int"


def kept(rows, good):
    """Ids, integers and labels of usable vectors, by id (nulls last), then components."""
    out = []
    for i, v, label, *_ in rows:
        if v and good(v) and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def apart(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def nearest(x, entries):
    return min(range(len(entries)), key=lambda e: (apart(x, entries[e]), e))


def moved(entries, xs, at):
    out = []
    for e, old in enumerate(entries):
        mine = [x for x, a in zip(xs, at, strict=True) if a == e]
        out.append([sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else old)
    return out


def plain_codes(rows, parts=16, entries=64, rounds=2):
    found = kept(rows, lambda v: len(v) % parts == 0)
    out = []
    for dims in sorted({len(v) for _, v, _ in found}):
        mine = [r for r in found if len(r[1]) == dims]
        w = dims // parts
        codes, errors, digest = [[] for _ in mine], [0] * len(mine), []
        for p in range(parts):
            xs = [v[p * w : (p + 1) * w] for _, v, _ in mine]
            book = xs[:entries]
            for _ in range(rounds):
                book = moved(book, xs, [nearest(x, book) for x in xs])
            for k, x in enumerate(xs):
                codes[k].append(nearest(x, book))
                errors[k] += apart(x, book[codes[k][-1]])
            digest += [c for e in book for c in e]
        sha = hashlib.sha256(",".join(map(str, digest)).encode()).hexdigest()
        out += [(i, bytes(c).hex(), e, label, sha) for (i, _, label), c, e in zip(mine, codes, errors, strict=True)]
    total = defaultdict(int)
    for _, _, e, label, _ in out:
        total[label] += e
    return sorted(((i, c, e, total[label], sha) for i, c, e, label, sha in out), key=repr)


def plain_clusters(rows, k=40, rounds=5, dims=64):
    found = kept(rows, lambda v: len(v) == dims)
    rank = {i: hashlib.sha256(f"2:{i}".encode()).hexdigest() for i, _, _ in found}
    first = sorted(found, key=lambda r: (r[0] is None, rank[r[0]], r[1]))[:k]
    centres, xs = [v for _, v, _ in first], [v for _, v, _ in found]
    for _ in range(rounds):
        centres = moved(centres, xs, [nearest(x, centres) for x in xs])
    at = [nearest(x, centres) for x in xs]
    far = [apart(x, centres[a]) for x, a in zip(xs, at, strict=True)]
    within = defaultdict(int)
    for a, d in zip(at, far, strict=True):
        within[a] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, a, d, within[a], sum(far), sha[a]) for (i, _, _), a, d in zip(found, at, far, strict=True)), key=repr)


def rows_of(seed, n, dims, spread):
    """Few different values, so that distances tie and vectors repeat."""
    rng = np.random.default_rng(seed)
    rows = [(int(i), (rng.integers(-spread, spread + 1, dims) / 64).tolist(), int(i) % 3, "c", 1) for i in rng.permutation(n)]
    rows += [(7, rows[3][1], None, "c", 1), (n, rows[3][1], None, None, 1), rows[5], rows[5], (None, rows[9][1], 2, "c", None)]
    odd = [None, [], [0.5] * (dims - 1), [0.5] * (dims - 1) + [None], [0.5] * (dims - 1) + [float("nan")], [float("inf")] + [0.5] * (dims - 1)]
    return rows + [(n + 1 + k, v, None, "c", 1) for k, v in enumerate(odd)]


@pytest.mark.parametrize(("n", "spread", "dims"), [(150, 1, 32), (150, 100, 16), (20, 3, 48)])
def test_codes_equal_plain_loops(spark, n, spread, dims):
    rows = rows_of(n, n, dims, spread)
    rows += [(2000 + k, [k / 8] * (2 * dims), 1, "x", 0) for k in range(5)]  # of another length
    got = vector_codes.code_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_codes(rows)


def test_orchard_search_looks_at_few_entries_and_decodes():
    rng = np.random.default_rng(4)
    search = vector_codes.Orchard(rng.integers(-300, 300, (64, 4)))
    x = rng.integers(-300, 300, (3000, 4))
    at, far = search.nearest(x)
    every = ((x[:, None] - search.entries[None]) ** 2).sum(-1)
    assert (at == every.argmin(1)).all() and (far == every.min(1)).all()
    books = vector_codes.Codebooks(np.stack([search.entries, search.entries]))
    index, _ = books.assign(x.reshape(-1, 8))
    decoded = books.decode([c.tobytes().hex() for c in index.astype(np.uint8)])
    assert (decoded == search.entries[at].reshape(-1, 8)).all()


def test_one_entry_and_equal_entries():
    one = vector_codes.Orchard(np.array([[3, 4]]))
    assert [a.tolist() for a in one.nearest(np.array([[0, 0], [3, 4]]))] == [[0, 0], [25, 0]]
    same = vector_codes.Orchard(np.array([[1, 1], [5, 5], [1, 1], [3, 3]]))
    assert same.nearest(np.array([[1, 1], [2, 2], [4, 4]]))[0].tolist() == [0, 0, 1]


@pytest.mark.parametrize(("n", "spread"), [(120, 1), (120, 90), (25, 3)])
def test_clusters_equal_plain_loops(spark, n, spread):
    rows = rows_of(n + 1, n, 64, spread)
    got = vector_clusters.cluster_vectors(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_clusters(rows)


@pytest.mark.parametrize("dims", [1, 2, 8, 64])
def test_transform_is_exact_and_ordered(dims):
    h = vector_clusters.transform(np.eye(dims, dtype=np.int64)).T
    assert (h @ h.T == dims * np.eye(dims)).all()
    assert [(np.diff(r) != 0).sum() for r in h] == list(range(dims))
    x = np.random.default_rng(0).integers(-(1 << 23), 1 << 23, (2, dims))
    assert ((h @ x[0] - h @ x[1]) ** 2).sum() == dims * ((x[0] - x[1]) ** 2).sum()


def test_empty_and_large(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert vector_codes.code_vectors(empty).count() == 0 and vector_clusters.cluster_vectors(empty).count() == 0
    with pytest.raises(Exception, match="65536 or more"):
        vector_clusters.cluster_vectors(spark.createDataFrame([(1, [1e6] * 64, 1, "", 1)], SCHEMA)).collect()


TEXTS = [None, "", "a  b", "a \n b", "  x ", "x \t　 y", "a\x1c  \x1c.b", "a  <|endoftext|> b", "don't 's it' s", "ñé,%% x²", "word. " * 900, "\n\n a\x85b​c", "9" * 30, "é" * 4000]


@pytest.fixture(scope="module")
def whole():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize(("memo", "block"), [(800_000, 2_000_000), (50, 9)])
def test_runs_equal_whole_texts(whole, monkeypatch, memo, block):
    monkeypatch.setattr(packing, "MEMO_RUNS", memo)
    monkeypatch.setattr(packing, "BLOCK_CHARS", block)
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        enc = packing.RunEncoder(f.read())
    rng = np.random.default_rng(1)
    letters = list("ab1.' \n\t \x85\xa0　​é\x1c²٣_-")
    texts = TEXTS + ["".join(rng.choice(letters, 30)) for _ in range(400)] + ["".join(rng.choice(list("ab.  \n'"), 60)) for _ in range(400)]
    for _ in range(2):
        assert [np.frombuffer(b, "<u4").tolist() for b in map(enc.encode, texts)] == [whole(t) for t in texts]


def test_differencing_deals_all_and_evenly():
    rng = np.random.default_rng(2)
    for n, k in ((1, 1), (1, 4), (5, 3), (600, 80)):
        sizes = rng.integers(1, 513, n)
        part, sums = packing.differencing(sizes, k)
        assert np.bincount(part, sizes, k).tolist() == sums[np.arange(k)].tolist()
        if n == 600:
            assert sums.max() - sums.min() < 60
    # The classic example: differencing 8, 7, 6, 5, 4 in two parts leaves a difference of two.
    assert sorted(packing.differencing(np.array([8, 7, 6, 5, 4]), 2)[1].tolist()) == [14, 16]
    assert packing.windows_of(np.array([2047, 2047, 2]))[1] == 3


def test_pieces_make_full_windows(spark, whole):
    rng = np.random.default_rng(3)
    texts = TEXTS + [" ".join(rng.choice(["ab", "cde", "f.", "Ghi"], int(n))) for n in rng.integers(1, 3000, 120)]
    rows = [(i, t, 7, "x") for i, t in enumerate(texts)] + [(3, "again", 1, None), (None, "no id", 1, None), (5, texts[5], 7, "x"), (20, texts[20], 7, "x"), (20, texts[20], 7, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, turn int, ids string").repartition(3)
    pieces, places = packing.pack(docs, tokenizer_path("byte_bpe_50k.json"), group_tokens=40_000)
    got = places.collect()
    want = sorted(([i, *whole(t), 1] for i, t, *_ in rows), key=repr)
    windows = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.windows(pieces, places).collect()}
    by_window, total = defaultdict(list), 0
    cover = defaultdict(list)
    for r in got:
        ids = windows[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and len(ids) == r["length"]
        by_window[r["sequence_id"]].append((r["offset"], r["length"]))
        cover[(r["doc_id"], r["doc_tokens"])].append((r["start"], ids))
        total += r["length"]
    for w, parts in by_window.items():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at == len(windows[w]) <= 2048
    assert total == sum(len(ids) - 1 for ids in want)
    assert 2048 * len(by_window) - total < 0.05 * total
    once = {(i, len(ids)): ids for i, *ids in want}
    for (i, n), parts in cover.items():
        copies = sum(1 for w in want if w[0] == i and len(w) - 1 == n)
        ids = [x for _, p in sorted(parts)[::copies] for x in p]
        assert ids == once[(i, n)]
    assert packing.packing_digest(docs.limit(0), tokenizer_path("byte_bpe_50k.json")).count() == 0
