"""A self-join of documents on the Jaccard similarity of their word shingles.

Words are runs of anything but ASCII white space, with A-Z lower-cased; a
shingle is ``SHINGLE`` consecutive words (all words of a shorter text). Two
documents link if their shingle sets have a Jaccard similarity of
``THRESHOLD`` or more.

Candidates come from a MinHash LSH forest: ``TREES`` prefix tries, each over
its own sequence of min-hashes. Matched prefixes are shortened from ``DEPTH``
min-hashes on until a pair at the threshold shares one with probability
``RECALL`` (``floor_depth``). Shortening never ends by what has been found
before, since pairs that haven't met yet may be less alike. A document's label
in a tree is a sorted prefix: the ``floor`` first min-hashes as one value, which
rows are grouped by, then ``LEVELS`` more, by which two documents of a group
have a depth in common. A pair belongs to the tree where its prefixes agree
longest (of those to the first), so it is verified once.

1. A scan makes each document's shingle set, its fingerprint and its labels.
   Documents with equal sets (exact copies above all) form one class; classes
   go on with one representative and a count.
2. Representatives with equal floors meet. Large groups are dealt out in pairs
   of bounded blocks. Near copies that all differ would meet in most trees,
   so large groups that share a document are taken together (``herds``) where
   that makes fewer rows: the documents of a herd meet once, not once a tree,
   and aren't compared again in the small groups that they also share.
3. The texts of those with a pair of their own are brought to their blocks and
   every pair is verified on whole shingle sets, as a product of membership
   matrices. A block gives counts of links and the edges of a spanning forest,
   never its pairs. Components of those edges name the groups.

Of a herd of n near copies that all differ, n / ``BLOCK`` texts reach a block
for each of its rows: every pair is compared, and a task holds two blocks.

Classes are named by the fingerprints of their sets, so ids may come more than
once, on equal or different texts.

Defined results: texts that are null or without words, and rows without an id,
link with nothing and are groups of their own; repeated rows are copies; an
empty table gives an empty result. Extra columns are ignored, whatever their
names. ``drop_near`` keeps of each group the first row by id, then text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.blocks import block_pairs, components, groups, join_hot, roots
from quarry.llm.rows import slices, small_batches, trim
from quarry.llm.shared import stage

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 10
RECALL = 0.999
#: Levels of a trie above its floor, each of 16 bits.
LEVELS = 4
#: Documents and characters of a block.
BLOCK, BLOCK_CHARS = 512, 8_000_000
#: Cells of a membership matrix that a task holds at once.
MATRIX_CELLS = 4_000_000
BLANKS = " \t\n\v\f\r"

_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
_STEP = np.arange(1, 65, dtype=np.uint64) * _MIX[1]


def found(similarity: float, depth: int, trees: int = TREES) -> float:
    """The probability that a pair shares a prefix of a depth in some tree."""
    return 1 - (1 - similarity**depth) ** trees


def floor_depth(threshold: float = THRESHOLD, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix with which a pair at the threshold is found with the target recall."""
    for d in range(depth, 0, -1):
        if found(threshold, d, trees) >= recall:
            return d
    raise ValueError(f"{trees} trees can't reach a recall of {recall} at {threshold}")


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX[4]
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    k = min(n, len(h))
    if not k:
        return h
    out = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _MIX[0] + _mixed(h[i : len(h) - k + 1 + i] + _STEP[i % len(_STEP)])
    return np.unique(_mixed(out))


class Forest:
    """Labels of a shingle set: for each tree its floor, a 64-bit hash that also
    names the tree, and the levels above, 16 bits each, the first in the highest bits."""

    def __init__(self, trees: int, floor: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        n = trees * (floor + LEVELS)
        self.a = (rng.integers(0, 1 << 32, (n, 1), np.uint64) | np.uint64(1)).astype(np.uint32)
        self.b = rng.integers(0, 1 << 32, (n, 1), np.uint64).astype(np.uint32)
        self.trees, self.floor = trees, floor

    def labels(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = (hashes >> np.uint64(32)).astype(np.uint32)[None, :]
        low = None
        for i in range(0, x.shape[1], 2048):
            part = (self.a * x[:, i : i + 2048] + self.b).min(1)
            low = part if low is None else np.minimum(low, part)
        low = low.reshape(self.trees, -1).astype(np.uint64)
        out = np.arange(1, self.trees + 1, dtype=np.uint64) * _MIX[2]
        for k in range(self.floor):
            out = _mixed(out * _MIX[0] + low[:, k] + _MIX[3])
        above = np.zeros(self.trees, np.uint64)
        for k in range(self.floor, self.floor + LEVELS):
            above = (above << np.uint64(16)) | (_mixed(low[:, k] + _MIX[3]) & np.uint64(0xFFFF))
        return out.view(np.int64), above.view(np.int64)


SIGNED = "doc_id long, text_key long, set binary, n_chars long, floors array<long>, above array<long>"


def sign(docs: DataFrame, id_col: str, text_col: str, forest: Forest) -> DataFrame:
    """Fingerprint and labels of every document that has words and an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in slices(batches):
            some, sets, chars, floors, above = [], [], [], [], []
            for k, text in enumerate(batch.column(2).to_pylist()):
                h = shingles(text)
                if len(h):
                    some.append(k)
                    sets.append(xxhash.xxh3_128_digest(h.tobytes()))
                    chars.append(len(text))
                    low, high = forest.labels(h)
                    floors.append(low)
                    above.append(high)
            offsets = pa.array(np.arange(len(some) + 1, dtype=np.int32) * forest.trees)
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x) if x else np.array([], np.int64))) for x in (floors, above)]
            some = pa.array(some, pa.int64())
            columns = [batch.column(0).take(some), batch.column(1).take(some), pa.array(sets, pa.binary()), pa.array(chars, pa.int64()), *lists]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in SIGNED.split(", ")])

    rows = docs.select(*_keys(id_col, text_col), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")
    return rows.mapInArrow(run, SIGNED)


def _keys(id_col: str, text_col: str) -> list:
    return [F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_key")]


def _meet(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of a block pair (of rows in different blocks, unless it is one)
    that belong to this bucket, as the numbers of their rows.

    In a herd those are all pairs with equal floors in some tree. Elsewhere, a
    pair of one herd is left to that, and any other belongs to the tree where it
    agrees on most, of those to the first."""
    bucket, bi, bj = (group.column(k)[0].as_py() for k in range(3))
    mine, floors, above = group.column("mine").to_numpy(), _matrix(group.column("floors")), _matrix(group.column("above"))
    herd = group.column("herd").combine_chunks()
    inside, herd = herd.is_valid().to_numpy(zero_copy_only=False), herd.fill_null(0).to_numpy()
    if bi == bj:
        left = right = np.arange(len(mine))
    else:
        left, right = np.flatnonzero(mine == bi), np.flatnonzero(mine == bj)
    if inside[0] and herd[0] == bucket:
        meets = np.zeros((len(left), len(right)), bool)
        for t in range(floors.shape[1]):
            meets |= floors[left, t][:, None] == floors[right, t][None, :]
    else:
        meets = ~((herd[left][:, None] == herd[right][None, :]) & inside[left][:, None] & inside[right][None, :])
    i, j = np.nonzero(np.triu(meets, 1) if bi == bj else meets)
    i, j = left[i], right[j]
    if inside[0] and herd[0] == bucket:
        return i, j
    tree = int(np.argmax(floors[0] == bucket))
    # A tree's label down to each level; that of the last level is the whole one.
    labels = [floors.view(np.uint64)]
    for k in range(1, LEVELS + 1):
        part = above.view(np.uint64) >> np.uint64(16 * (LEVELS - k))
        labels.append(floors.view(np.uint64) ^ _mixed(part * _MIX[0] + _MIX[1]))
    level = np.zeros(len(i), np.int8)
    for k in range(1, LEVELS + 1):
        level += labels[k][i, tree] == labels[k][j, tree]
    own = []
    for k in range(LEVELS, -1, -1):
        at = np.flatnonzero(level == k)
        others = [(k, t) for t in range(tree)] + [(k + 1, t) for t in range(floors.shape[1]) if k < LEVELS and t != tree]
        for deep, t in others:
            if not len(at):
                break
            x = labels[deep][:, t]
            at = at[x[i[at]] != x[j[at]]]
        own.append(at)
    own = np.concatenate(own)
    return i[own], j[own]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


NEEDED = "bucket long, bi int, bj int, mine int, set binary"
LINKED = "a binary, b binary, n long"


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _batch(schema: str, out: list[list]) -> pa.RecordBatch:
    """The columns of several parts, one after another."""
    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*out, strict=True)) or [()] * len(fields)
    kinds = [_ARROW[kind] for _, kind in fields]
    arrays = [pa.concat_arrays([pa.array([], k), *(x if isinstance(x, pa.Array) else pa.array(x, k) for x in c)]) for k, c in zip(kinds, columns, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, [name for name, _ in fields])


def _needed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each block pair, the rows that have a pair of their own there."""
    out: list[list] = []
    for group in groups(batches, 3):
        if group.num_rows < 2:
            continue
        rows = np.unique(np.concatenate(_meet(group)))
        if n := len(rows):
            bucket, bi, bj = (group.column(k)[0].as_py() for k in range(3))
            names = group.column("set").combine_chunks()
            out.append([np.full(n, bucket), np.full(n, bi, np.int32), np.full(n, bj, np.int32), group.column("mine").to_numpy()[rows], names.take(pa.array(rows))])
        if len(out) >= 5000:
            yield _batch(NEEDED, out)
            out = []
    yield _batch(NEEDED, out)
    trim()


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sorted distinct sets share."""
    n = len(sets)
    if n == 2:
        k = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), k], [k, len(sets[1])]])
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, place, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    often = times > 1
    number = np.cumsum(often) - 1
    keep = often[place]
    owner, place = owner[keep], number[place[keep]]
    out = np.zeros((n, n), np.float32)  # whole numbers, exact up to 2 ** 24 words
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    width = max(256, MATRIX_CELLS // n)
    for lo in range(0, int(often.sum()), width):
        a, b = np.searchsorted(place, (lo, lo + width))
        m = np.zeros((n, width), np.float32)
        m[owner[a:b], place[a:b] - lo] = 1
        out += m @ m.T
    return out


def _verify(threshold: float):
    """The links of each block pair: a link to the first of its rows that each
    row reaches, and how many documents it links with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = []
        for group in groups(batches, 3):
            if group.num_rows < 2:
                continue
            i, j = _meet(group)
            if not len(i):
                continue
            sets = [shingles(t) for t in group.column("text").to_pylist()]
            size = np.array([len(s) for s in sets], float)
            both = shared_counts(sets)[i, j].astype(float)
            near = both >= threshold * (size[i] + size[j] - both) - 1e-9
            if near.any():
                links = np.zeros((len(sets), len(sets)), bool)
                links[i[near], j[near]] = links[j[near], i[near]] = True
                some = np.flatnonzero(links.any(1))
                names = group.column("set").combine_chunks()
                root = roots(links, np.arange(len(sets)))
                out.append([names.take(pa.array(some)), names.take(pa.array(root[some])), (links @ group.column("copies").to_numpy())[some]])
            if len(out) >= 2000:
                yield _batch(LINKED, out)
                out = []
        yield _batch(LINKED, out)
        trim()

    return run


def herds(members: DataFrame, block: int) -> tuple[DataFrame, DataFrame] | None:
    """Large groups to take together. members: ``set``, ``n_chars``, ``bucket``.

    Groups of more than one block that share a document, directly or over
    others, are a herd, if dealing out its documents once makes fewer rows than
    dealing out each of its groups. Returns the documents of the herds (``set``,
    ``herd``; a document has one at most) and the buckets that they replace; a
    herd is named after one of these. None if no group is that large."""
    blocks = lambda n, chars: F.ceil(F.greatest(F.col(n) / F.lit(block), F.col(chars) / F.lit(BLOCK_CHARS), F.lit(1)))
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).filter("n > 1")
    large = stage(sizes.withColumn("nb", blocks("n", "chars")).filter("nb > 1"), "large")
    if large.isEmpty():
        return None
    rows = stage(members.join(large.select("bucket"), "bucket").select("set", "n_chars", "bucket"), "large-members")
    first = rows.groupBy("set").agg(F.min("bucket").alias("a"), F.first("n_chars").alias("n_chars"))
    named = components(rows.join(first.select("set", "a"), "set").select("a", F.col("bucket").alias("b")).filter("a < b").distinct())
    buckets = stage(large.join(named, large["bucket"] == named["node"], "left").select("bucket", F.coalesce("component", "bucket").alias("herd"), (F.col("n") * F.col("nb")).alias("apart")), "herd-buckets")
    docs = stage(first.join(buckets.select(F.col("bucket").alias("a"), "herd"), "a").select("set", "n_chars", "herd"), "herd-documents")
    whole = docs.groupBy("herd").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars")).withColumn("together", F.col("n") * blocks("n", "chars"))
    chosen = stage(buckets.groupBy("herd").agg(F.sum("apart").alias("apart")).join(whole, "herd").filter("together < apart").select("herd"), "herds")
    return docs.join(chosen, "herd", "left_semi").select("set", "herd"), buckets.join(chosen, "herd", "left_semi").select("bucket")


def _met(reps: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """Rows that meet in a bucket or herd (``bucket``, ``bi``, ``bj``, the row's
    block ``mine``, ``set``), and what is known of each ``set``: its ``copies``,
    labels and ``herd``."""
    members = reps.select("set", "n_chars", F.explode("floors").alias("bucket"))
    found = herds(members, block)
    if found is None:
        labels = reps.drop("n_chars").withColumn("herd", F.lit(None).cast("long"))
    else:
        docs, replaced = found
        together = reps.select("set", "n_chars").join(docs, "set").select("set", "n_chars", F.col("herd").alias("bucket"))
        members = members.join(replaced, "bucket", "left_anti").select("set", "n_chars", "bucket").unionByName(together)
        labels = reps.drop("n_chars").join(docs, "set", "left")
    return block_pairs(members, "bucket", F.xxhash64("set"), block, "n_chars", BLOCK_CHARS), labels


def _grouped(docs: DataFrame, id_col: str, text_col: str, threshold: float, trees: int, recall: float, block: int) -> DataFrame:
    """One row per document with words and an id: ``doc_id``, ``text_key``,
    ``lead`` (both of the first of its group), ``n_links`` and ``n_copies``."""
    floor = floor_depth(threshold, trees, recall=recall)
    with small_batches(docs.sparkSession):
        signed = stage(sign(docs, id_col, text_col, Forest(trees, floor)), "signed")
    classes = stage(
        signed.groupBy("set").agg(F.min(F.struct("doc_id", "text_key")).alias("rep"), F.count("*").alias("copies"), F.max("n_chars").alias("n_chars"), F.first("floors").alias("floors"), F.first("above").alias("above")),
        "classes",
    )
    reps = classes.select("set", "copies", "n_chars", "floors", "above")
    keys = ["bucket", "bi", "bj"]
    met, labels = _met(reps, block)
    met = met.join(labels, "set").select(*keys, "mine", "set", "floors", "above", "herd")
    needed = stage(met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_needed, NEEDED), "needed")
    active = needed.select("set").distinct().join(classes.select("set", "rep.*"), "set")
    texts = docs.select(*_keys(id_col, text_col), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")
    # Rows of one id and text are equal, any of them will do.
    texts = active.join(texts, ["doc_id", "text_key"]).dropDuplicates(["set"]).select("set", "text")
    texts = stage(labels.join(texts, "set").select("set", "copies", "floors", "above", "herd", "text"), "texts")
    ready = needed.join(texts, "set").select(*keys, "mine", "set", "copies", "floors", "above", "herd", "text")
    with small_batches(docs.sparkSession):
        edges = stage(ready.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verify(threshold), LINKED), "linked")
    named = components(edges.select("a", "b"))
    counts = edges.groupBy("a").agg(F.sum("n").alias("n"))
    nodes = stage(named.join(classes.select(F.col("set").alias("node"), "rep"), "node"), "near-nodes")
    leads = stage(nodes.groupBy("component").agg(F.min("rep").alias("lead"), F.count("*").alias("times")), "near-leads")
    nodes = join_hot(nodes.select("node", "component"), leads, ["component"], "times").select("node", "lead")
    done = (
        classes.join(nodes, classes["set"] == nodes["node"], "left")
        .join(counts, classes["set"] == counts["a"], "left")
        .select("set", "copies", F.coalesce("lead", "rep").alias("lead"), (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"))
    )
    rows = join_hot(signed.select("doc_id", "text_key", "set"), stage(done, "near-classes"), ["set"], "copies")
    return rows.select("doc_id", "text_key", "lead", "n_links", F.col("copies").alias("n_copies"))


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    trees: int = TREES,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (the smallest id of its
    group), ``n_links`` (other documents linked with it directly), ``n_copies``
    (documents with its shingle set, itself included) and ``kept`` (whether the
    group is named after it)."""
    rows = _grouped(docs, id_col, text_col, threshold, trees, recall, block)
    rows = rows.select("doc_id", F.col("lead.doc_id").alias("class_id"), "n_links", "n_copies")
    one = F.lit(1).cast("long")
    alone = docs.select(F.col(id_col).cast("long").alias("doc_id"), _wordless(text_col).alias("none")).filter("none or doc_id is null")
    alone = alone.select("doc_id", F.col("doc_id").alias("class_id"), (one - 1).alias("n_links"), one.alias("n_copies"))
    return rows.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))


def _wordless(text_col: str) -> Column:
    return F.coalesce(F.trim(F.col(text_col), F.lit(BLANKS)) == "", F.lit(True))


def drop_near(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = THRESHOLD,
    trees: int = TREES,
    recall: float = RECALL,
    block: int = BLOCK,
) -> DataFrame:
    """One row of each group, the first by id, text and other columns, with all
    its columns, and all rows without words or an id."""
    kept = _grouped(docs, id_col, text_col, threshold, trees, recall, block).select("lead.*").distinct()
    rest = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)))
    rows = docs.select(F.struct("*").alias("row"), *_keys(id_col, text_col), _wordless(text_col).alias("none"), rest.alias("rest"))
    order = Window.partitionBy("doc_id", "text_key").orderBy("rest")
    first = rows.filter("doc_id is not null and not none").join(kept, ["doc_id", "text_key"], "left_semi")
    first = first.withColumn("place", F.row_number().over(order)).filter("place = 1")
    return first.select("row").unionByName(rows.filter("doc_id is null or none").select("row")).select("row.*")
