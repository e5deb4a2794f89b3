"""Compact codes of vectors: one codebook entry for each part, found by Orchard search.

A vector's components become integers (``floor(256 * x)``) and are cut into
``parts`` equal consecutive parts. Each part position has a codebook of up to
``entries`` entries; it starts as that part of the vectors with the smallest
ids, and each of ``rounds`` rounds assigns every part to the nearest entry
(ties to the lower index) and moves each entry to the floor of its parts' mean;
entries without parts stay. Codes and errors come from one more assignment.

The nearest entry is found by Orchard's search: every entry has a list of all
others, sorted by distance from it. A search stands at an entry and goes down
its list; an entry nearer to the part (or as near, with a lower index) becomes
the place to stand, and its list is taken up from the top. Entries that were
looked at are marked and never measured again. Beyond twice the current distance
no entry of the list can be nearer or as near, so the search stops there. All
parts of a batch go on side by side.

Each round is one scan: a task adds up its parts by entry and sends a row for
each entry of each part at most, Spark sums these rows, and the driver gets the
codebooks, whose size doesn't depend on the number of vectors.

Defined results: vectors that are null, empty or hold null or non-finite
components are dropped, as are those whose length isn't a multiple of
``parts``; vectors of each length have codebooks of their own; rows without an
id are coded but come last where codebooks start; repeated rows are coded one
by one; equal ids go by components; with fewer vectors than ``entries`` the
codebooks are smaller; an empty table gives an empty result; a label's error
that leaves 64 bits is null; components of 65,536 or more are an error. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.blocks import join_hot
from quarry.llm.shared import stage
from quarry.llm.vectors import floors, integer_groups, selected, usable

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Parts of vectors that are searched side by side.
SLICE = 16_384


class Orchard:
    """Exact nearest-entry search in one codebook (entries by components, integers)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n = len(entries)
        apart = ((entries[:, None] - entries[None]) ** 2).sum(-1)
        apart[np.arange(n), np.arange(n)] = -1  # the entry itself comes first, and goes
        order = np.argsort(apart, axis=1, kind="stable")[:, 1:]
        # Each list ends with a place that no search passes.
        self.gaps = np.hstack([np.take_along_axis(apart, order, 1), np.full((n, 1), np.iinfo(np.int64).max)])
        self.lists = np.hstack([order, np.zeros((n, 1), order.dtype)])
        sums = entries.sum(1)
        self.by_sum = np.argsort(sums, kind="stable")
        self.sums = sums[self.by_sum]

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, the lowest of several, and its squared distance."""
        found = [self._nearest(x[i : i + SLICE]) for i in range(0, len(x), SLICE)]
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def _nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(self.entries)
        at = self.by_sum[np.minimum(np.searchsorted(self.sums, x.sum(1)), n - 1)]
        best = ((x - self.entries[at]) ** 2).sum(1)
        marked = np.zeros((len(x), n), bool)
        marked[np.arange(len(x)), at] = True
        place = np.zeros(len(x), np.int64)
        live = np.arange(len(x))
        while len(live):
            live = live[self.gaps[at[live], place[live]] <= 4 * best[live]]
            other = self.lists[at[live], place[live]]
            place[live] += 1
            new = ~marked[live, other]
            rows, other = live[new], other[new]
            marked[rows, other] = True
            far = ((x[rows] - self.entries[other]) ** 2).sum(1)
            better = (far < best[rows]) | ((far == best[rows]) & (other < at[rows]))
            rows, other = rows[better], other[better]
            at[rows], best[rows], place[rows] = other, far[better], 0
        return at, best


@dataclass
class Codebooks:
    """Codebooks of vectors of one length, by part, entry and component."""

    entries: np.ndarray

    @cached_property
    def searches(self) -> list[Orchard]:
        return [Orchard(e) for e in self.entries]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry and squared distance of every part of integer vectors, vectors by parts."""
        parts, _, width = self.entries.shape
        x = x.reshape(len(x), parts, width)
        found = [s.nearest(x[:, p]) for p, s in enumerate(self.searches)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def decode(self, codes: list[str]) -> np.ndarray:
        """The vectors that codes stand for, as integers."""
        index = np.array([list(bytes.fromhex(c)) for c in codes], np.int64).reshape(-1, len(self.entries))
        return np.concatenate([e[index[:, p]] for p, e in enumerate(self.entries)], 1)

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


SUMS = "dims int, part int, entry int, n long, sums array<long>"
CODED = "vec_id long, label string, code string, error long, codebooks_sha256 string"


def _sums(books):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for dims, (_, x) in integer_groups(batch.column(0)).items():
                book = books.value.get(dims)
                if book is None:
                    continue
                parts, entries, width = book.entries.shape
                n, sums = total.setdefault(dims, (np.zeros((parts, entries), np.int64), np.zeros((parts, entries, width), np.int64)))
                index, _ = book.assign(x)
                for p in range(parts):
                    n[p] += np.bincount(index[:, p], minlength=entries)
                    np.add.at(sums[p], index[:, p], x[:, p * width : (p + 1) * width])
        for dims, (n, sums) in total.items():
            part, entry = np.nonzero(n)
            rows = sums[part, entry]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.array(rows.reshape(-1)))
            numbers = [pa.array(np.full(len(part), dims), pa.int32()), pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(n[part, entry])]
            yield pa.RecordBatch.from_arrays([*numbers, lists], ["dims", "part", "entry", "n", "sums"])

    return run


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> dict[int, Codebooks]:
    """Codebooks by length of vectors. rows: ``vec_id`` and ``v``; see ``selected``."""
    if not 1 <= entries <= 256:
        raise ValueError("a code has a byte for each part, so from 1 to 256 entries")
    spark = rows.sparkSession
    kept = rows.select("vec_id", "v").filter(usable() & (F.size("v") % parts == 0))
    by_id = Window.partitionBy(F.size("v")).orderBy(F.asc_nulls_last("vec_id"), "v")
    first: dict[int, list] = {}
    for r in kept.withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= entries).orderBy("place").collect():
        first.setdefault(len(r["v"]), []).append(r["v"])  # at most ``entries`` of each length
    books = {dims: Codebooks(floors(np.array(v)).reshape(len(v), parts, -1).swapaxes(0, 1)) for dims, v in first.items()}
    width = max((dims // parts for dims in books), default=0)
    for _ in range(rounds if books else 0):
        sent = spark.sparkContext.broadcast(books)
        sums = rows.select("v").mapInArrow(_sums(sent), SUMS).groupBy("dims", "part", "entry")
        total = sums.agg(F.sum("n").alias("n"), *(F.sum(F.get("sums", F.lit(i))).alias(f"s{i}") for i in range(width))).collect()
        moved = {dims: b.entries.copy() for dims, b in books.items()}
        for r in total:  # a row for each entry
            moved[r["dims"]][r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(r["dims"] // parts)]
        books = {dims: Codebooks(e) for dims, e in moved.items()}
        sent.destroy()
    return books


def encode(rows: DataFrame, books: dict[int, Codebooks]) -> DataFrame:
    """``vec_id``, ``label``, ``code``, ``error`` and ``codebooks_sha256`` of
    every vector that has codebooks. rows: ``vec_id``, ``v`` and ``label`` (text)."""
    sent = rows.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = {dims: b.digest() for dims, b in sent.value.items()}
        for batch in batches:
            for dims, (at, x) in integer_groups(batch.column(1)).items():
                if dims not in digests:
                    continue
                index, far = sent.value[dims].assign(x)
                codes = [c.tobytes().hex() for c in index.astype(np.uint8)]
                at = pa.array(at)
                columns = [batch.column(0).take(at), batch.column(2).take(at), pa.array(codes, pa.string()), pa.array(far.sum(1)), pa.array([digests[dims]] * len(codes), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error", "codebooks_sha256"])

    return rows.select("vec_id", "v", "label").mapInArrow(run, CODED)


def code_vectors(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | Column | None = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per coded vector: ``vec_id``, ``code``, ``error``, ``label_error``
    (errors summed over equal labels, nulls together) and ``codebooks_sha256``."""
    label = F.lit(None) if label_col is None else F.col(label_col) if isinstance(label_col, str) else label_col
    # A text for a label of any type; that of null is a text as well.
    rows = selected(vectors, id_col, vector_col, label=F.to_json(F.struct(label.alias("label"))))
    coded = stage(encode(rows, learn(rows, parts, entries, rounds)), "vector-codes")
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    sums = stage(coded.groupBy("label").agg(total.alias("label_error"), F.count("*").alias("times")), "label-errors")
    return join_hot(coded, sums, ["label"], "times").select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _oracle() -> str:
    """Components as rows; each round an assignment and a move."""
    near = (
        "a{r} AS (SELECT rid, part, e, d FROM (SELECT x.rid, x.part, c.e, sum((x.x - c.x) * (x.x - c.x)) AS d "
        "FROM x JOIN c{r} c ON x.part = c.part AND x.pos = c.pos GROUP BY ALL) "
        "QUALIFY row_number() OVER (PARTITION BY rid, part ORDER BY d, e) = 1)"
    )
    move = (
        "m{r} AS (SELECT x.part, a.e, x.pos, sum(x.x) AS s, count(*) AS n FROM x JOIN a{r} a ON x.rid = a.rid AND x.part = a.part GROUP BY ALL), "
        "c{q} AS (SELECT c.part, c.e, c.pos, CASE WHEN m.n IS NULL THEN c.x ELSE CAST((m.s - ((m.s % m.n) + m.n) % m.n) // m.n AS BIGINT) END AS x "
        "FROM c{r} c LEFT JOIN m{r} m ON c.part = m.part AND c.e = m.e AND c.pos = m.pos)"
    )
    rounds = ", ".join(f"{near.format(r=r)}, {move.format(r=r, q=r + 1)}" for r in range(ROUNDS))
    return f"""
WITH k AS (
  SELECT *, row_number() OVER (ORDER BY vec_id) - 1 AS rid FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda y: isfinite(y))) = len(embedding)),
u AS (SELECT rid, unnest(embedding) AS y, generate_subscripts(embedding, 1) - 1 AS i, len(embedding) // {PARTS} AS w FROM k),
x AS (SELECT rid, i // w AS part, i % w AS pos, CAST(floor(256 * CAST(y AS DOUBLE)) AS BIGINT) AS x FROM u),
c0 AS (SELECT part, rid AS e, pos, x FROM x WHERE rid < {ENTRIES}), {rounds}, {near.format(r=ROUNDS)},
s AS (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, e, pos)) AS h FROM c{ROUNDS}),
f AS (SELECT rid, string_agg(lower(lpad(hex(e), 2, '0')), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY rid)
SELECT k.vec_id, f.code, f.error, CAST(sum(f.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, s.h AS codebooks_sha256
FROM f JOIN k USING (rid) CROSS JOIN s"""


ORACLE_SQL = _oracle()
