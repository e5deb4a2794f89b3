"""Near-duplicate vectors by iterative quantisation and multi-index Hamming tables.

Rotations are learned from a bounded sample of different vectors (``FIT_ROWS``
with the lowest fingerprint): principal axes, then alternately signs and
the rotation that fits them best, each from another random start. A vector's
code has a bit per dimension and rotation. The code is cut into substrings of
about ``log2(n / BUCKET)`` bits, one hash table each, and as many tables are
made as it takes to find ``RECALL`` of sample vectors moved to a cosine of
exactly ``THRESHOLD`` in some table. Where ``MAX_ROTATIONS`` codes don't reach
that, the substrings get shorter (and buckets larger) until they do; if single
bits don't either, or for a dozen vectors, one bucket holds all, so that no pair
is left out. Every vector is indexed in every table.

Vectors that share a bucket are compared by the Hamming distance of their
whole codes; those within reach of the threshold are reranked with the
original vectors in double precision. A pair belongs to the first table where
it meets. Large buckets are dealt out in pairs of bounded blocks, and a block
gives counts of links and a spanning forest, never its pairs. Equal vectors
form a class, named by a fingerprint of the vector, that goes on once with a
count, so ids may come more than once, on equal or different vectors. Vectors
of each length have an index of their own.

The distance of codes within reach is ``REACH`` standard deviations above the
mean of the probes at the threshold, which leaves out less than one pair in a
million there; what the tables themselves leave out is at most ``1 - RECALL``
of the pairs at the threshold, and less of nearer ones.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components, and rows without an id, link with nothing and are components of
their own; repeated rows are copies; cosines within ``TIE`` of the threshold are
summed again in one order, so that a tie goes one way everywhere; an empty table
gives an empty result. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.blocks import block_pairs, components, groups, join_hot, roots
from quarry.llm.shared import stage

THRESHOLD = 0.9
FIT_ROWS = 20_000
RECALL = 0.995
#: Vectors that a bucket holds on average.
BUCKET = 8
BLOCK = 1024
ROUNDS = 30
#: Rotations from which on substrings get shorter instead.
MAX_ROTATIONS = 64
#: Standard deviations of the code distance at the threshold that still count as near.
REACH = 6.0
TIE = 1e-9
PROBES = 4000


@dataclass
class Index:
    """Centre, a rotation (dimensions by bits) of all bits, tables of ``bits`` bits, and the code distance that counts as near."""

    centre: np.ndarray
    rotation: np.ndarray
    bits: int
    tables: int
    per_code: int
    near: int

    def codes(self, x: np.ndarray) -> np.ndarray:
        """Packed codes of unit vectors."""
        return np.packbits((x - self.centre) @ self.rotation > 0, axis=1)

    def keys(self, codes: np.ndarray) -> np.ndarray:
        """The bucket of each code in each table; the table's number is in the high bits."""
        dims = len(self.centre)
        b = np.unpackbits(codes, axis=1)[:, : self.rotation.shape[1]]
        powers = (1 << np.arange(self.bits, dtype=np.int64))[::-1]
        out = np.empty((len(codes), self.tables), np.int64)
        for t in range(self.tables):
            at = t // self.per_code * dims + t % self.per_code * self.bits
            out[:, t] = b[:, at : at + self.bits].astype(np.int64) @ powers + (np.int64(t) << 40)
        return out


def _rotation(v: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Iterative quantisation: the rotation under which the vectors are closest to their signs."""
    r = np.linalg.qr(rng.standard_normal((v.shape[1], v.shape[1])))[0]
    for _ in range(ROUNDS):
        u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
        r = (u @ w).T
    return r


def fit(sample: np.ndarray, n: int, threshold: float = THRESHOLD, recall: float = RECALL, seed: int = 11) -> Index:
    """sample: different unit vectors; n: how many vectors will be indexed."""
    rng = np.random.default_rng(seed)
    dims = sample.shape[1]
    centre = sample.mean(0)
    v = sample - centre
    axes = np.linalg.eigh(v.T @ v + 1e-9 * np.eye(dims))[1][:, ::-1]
    bits = max(0, min(dims, 30, round(math.log2(max(1, n / BUCKET)))))
    # Rotations fit the vectors they are learned from better than others, so the probes are other ones:
    # sample vectors (each more than once if they are few) and, for each, one at the threshold itself.
    order = rng.permutation(len(sample))
    half = len(sample) // 2
    train, probe = v[order[:half][:5000]], sample[np.resize(order[half:], PROBES)]
    aside = rng.standard_normal(probe.shape)
    aside -= (aside * probe).sum(1, keepdims=True) * probe
    norm = np.linalg.norm(aside, axis=1, keepdims=True)
    moved = threshold * probe + math.sqrt(1 - threshold**2) * aside / np.where(norm > 0, norm, 1)
    if dims == 1:  # no vector but the same one is near
        moved = probe
    rotations: list[np.ndarray] = []
    same: list[np.ndarray] = []
    while True:
        per_code = dims // bits if bits else 1
        found = np.zeros(len(probe), bool)
        tables = used = 0
        while found.mean() < recall and used < MAX_ROTATIONS:
            if used == len(rotations):
                rotations.append(axes @ _rotation(train @ axes, rng))
                same.append(((probe - centre) @ rotations[-1] > 0) == ((moved - centre) @ rotations[-1] > 0))
            for t in range(per_code):
                if found.mean() < recall:
                    found |= same[used][:, t * bits : (t + 1) * bits].all(1)
                    tables += 1
            used += 1
            if bits == 0:
                break
        if found.mean() >= recall or bits == 0:
            break
        bits -= 1
    rotations = rotations[:used]
    rotation = np.hstack(rotations)
    apart = (((probe - centre) @ rotation > 0) != ((moved - centre) @ rotation > 0)).sum(1)
    near = int(min(rotation.shape[1], math.ceil(apart.mean() + REACH * apart.std() + 1))) if bits else rotation.shape[1]
    return Index(centre, rotation, bits, tables, per_code, near)


def unit(vectors: list[list[float]]) -> np.ndarray:
    x = np.array(vectors, np.float64)
    # A large or tiny vector's squares would leave the range of doubles.
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


CODED = "key binary, copies long, code binary, buckets array<long>"
NEEDED = "bucket long, bi int, bj int, mine int, key binary"
LINKED = "a binary, b binary, n long"


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def _near(codes: np.ndarray, mine: np.ndarray, bi: int, bj: int, index: Index) -> np.ndarray:
    """Pairs of a block pair whose codes are near."""
    n = len(codes)
    words = np.zeros((n, -(-codes.shape[1] // 8) * 8), np.uint8)
    words[:, : codes.shape[1]] = codes
    words = words.view(np.uint64)
    apart = np.zeros((n, n), np.int16)
    for w in words.T:
        apart += np.bitwise_count(w[:, None] ^ w[None, :])
    pairs = np.triu(apart <= index.near, 1)
    if bi != bj:
        pairs &= mine[:, None] != mine[None, :]
    return pairs


def _first(pairs: np.ndarray, codes: np.ndarray, bucket: int, index: Index) -> np.ndarray:
    """Those pairs that meet in no earlier table."""
    keys = index.keys(codes)
    for t in range(bucket >> 40):
        pairs = pairs & (keys[:, t][:, None] != keys[:, t][None, :])
    return pairs


def _batch(kinds: list[pa.DataType], names: list[str], out: list[list]) -> pa.RecordBatch:
    """The columns of several parts, one after another."""
    columns = list(zip(*out, strict=True)) or [()] * len(kinds)
    arrays = [pa.concat_arrays([pa.array([], k), *(x if isinstance(x, pa.Array) else pa.array(x, k) for x in c)]) for k, c in zip(kinds, columns, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names)


def _needed(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index_ = index.value
        shape = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()], ["bucket", "bi", "bj", "mine", "key"]
        out: list[list] = []
        for group in groups(batches, 3):
            if group.num_rows < 2:
                continue
            codes = _bytes(group.column(5))
            bi, bj, mine = group.column(1)[0].as_py(), group.column(2)[0].as_py(), group.column(3).to_numpy()
            pairs = _near(codes, mine, bi, bj, index_)
            if not pairs.any():
                continue
            bucket = group.column(0)[0].as_py()
            pairs = _first(pairs, codes, bucket, index_)
            some = np.flatnonzero(pairs.any(0) | pairs.any(1))
            if k := len(some):
                out.append([np.full(k, bucket), np.full(k, bi), np.full(k, bj), mine[some], group.column(4).combine_chunks().take(pa.array(some))])
            if len(out) >= 5000:
                yield _batch(*shape, out)
                out = []
        yield _batch(*shape, out)

    return run


def _linked(x: np.ndarray, pairs: np.ndarray, threshold: float) -> np.ndarray:
    """Those pairs of unit vectors that reach the threshold."""
    cos = x @ x.T
    links = pairs & (cos >= threshold)
    i, j = np.nonzero(pairs & (np.abs(cos - threshold) < TIE))
    links[i, j] = (x[i] * x[j]).sum(1) >= threshold
    return links


def _verify(index, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index_ = index.value
        shape = [pa.binary(), pa.binary(), pa.int64()], ["a", "b", "n"]
        out: list[list] = []
        for group in groups(batches, 3):
            if group.num_rows < 2:
                continue
            bucket, bi, bj = (group.column(k)[0].as_py() for k in range(3))
            mine, copies = group.column(3).to_numpy(), group.column(5).to_numpy()
            codes = _bytes(group.column(6))
            pairs = _first(_near(codes, mine, bi, bj, index_), codes, bucket, index_)
            links = _linked(unit(group.column(7).to_pylist()), pairs, threshold)
            links |= links.T
            some = np.flatnonzero(links.any(1))
            if len(some):
                keys = group.column(4).combine_chunks()
                root = roots(links, np.arange(len(links)))
                out.append([keys.take(pa.array(some)), keys.take(pa.array(root[some])), (links @ copies)[some]])
            if len(out) >= 2000:
                yield _batch(*shape, out)
                out = []
        yield _batch(*shape, out)

    return run


def _code(index):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = index.value.codes(unit(batch.column(2).to_pylist()))
                keys = index.value.keys(codes)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * keys.shape[1]), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), lists], ["key", "copies", "code", "buckets"])

    return run


def near_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    threshold: float = THRESHOLD,
    recall: float = RECALL,
    fit_rows: int = FIT_ROWS,
    block: int = BLOCK,
) -> DataFrame:
    """One row per vector: its id, ``n_links`` (other vectors linked directly),
    ``component_id`` (smallest id reachable by links) and ``kept``."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(F.col("vec_id").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("usable", usable)
    alone = rows.filter("not usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    # 0.0 and -0.0 are one number: adding 0.0 gives them one form.
    key = F.unhex(F.md5(F.concat_ws(",", F.transform("v", lambda x: (x + F.lit(0.0)).cast("string")))))
    members = stage(rows.filter("usable").select("vec_id", key.alias("key"), "v"), "vector-keys")
    different = stage(members.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")), "vectors")
    lengths = different.groupBy(F.size("v").alias("dims")).count().filter("count > 1").orderBy("dims").collect()
    linked = vectors.sparkSession.createDataFrame([], LINKED)
    for r in lengths:  # a row for each length that vectors have
        linked = linked.unionByName(_links(different.filter(F.size("v") == r["dims"]), r["count"], threshold, recall, fit_rows, block))
    named = components(linked.select("a", "b"))
    counts = linked.groupBy("a").agg(F.sum("n").alias("n"))
    nodes = stage(named.join(different.select(F.col("key").alias("node"), "rep"), "node"), "vector-nodes")
    leads = stage(nodes.groupBy("component").agg(F.min("rep").alias("lead"), F.count("*").alias("times")), "vector-leads")
    nodes = join_hot(nodes.select("node", "component"), leads, ["component"], "times").select("node", "lead")
    classes = different.drop("v")
    results = (
        classes.join(nodes, classes["key"] == nodes["node"], "left")
        .join(counts, classes["key"] == counts["a"], "left")
        .select("key", "copies", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("lead", "rep").alias("component_id"))
    )
    found = join_hot(members.select("vec_id", "key"), stage(results, "vector-classes"), ["key"], "copies")
    found = found.select("vec_id", "n_links", "component_id").unionByName(alone)
    return found.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _links(different: DataFrame, n: int, threshold: float, recall: float, fit_rows: int, block: int) -> DataFrame:
    """Links between ``n`` different vectors of one length, ``key``, ``copies`` and ``v``."""
    sample = different.orderBy("key").limit(fit_rows).select("key", "v").collect()  # the lowest fingerprints
    index = different.sparkSession.sparkContext.broadcast(fit(unit([r["v"] for r in sorted(sample, key=lambda r: bytes(r["key"]))]), n, threshold, recall))
    coded = stage(different.select("key", "copies", "v").mapInArrow(_code(index), CODED), "codes")
    met = block_pairs(coded.select("key", "code", F.explode("buckets").alias("bucket")), "bucket", F.xxhash64("key"), block)
    keys = ["bucket", "bi", "bj"]
    met = met.select(*keys, "mine", "key", "code").repartition(*keys).sortWithinPartitions(*keys)
    needed = stage(met.mapInArrow(_needed(index), NEEDED), "vectors-needed")
    vectors = coded.drop("buckets").join(different.select("key", "v"), "key")
    ready = needed.join(vectors, "key").select(*keys, "mine", "key", "copies", "code", "v")
    return stage(ready.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify(index, threshold), LINKED), "vectors-linked")
