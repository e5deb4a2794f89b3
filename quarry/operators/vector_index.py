"""A stored vector index: exact search by cosine that reads the cells it needs.

An index is a folder of tables:

    centers    cell, center: learned once, on at most about ``SAMPLE`` vectors
    blocks     cell, ids, values (unit vectors, one after another), least, most
               (cosines to the center); by batch and bucket, a range of cells
    cells      cell, n, least, most; by batch; negative n for deleted vectors
    deleted    cell, first, gone: ids gone from a block; by batch

Every vector is in the cell of its nearest center. A block holds up to ``BLOCK``
vectors of a cell that lie at about one distance from the center. Batches work as
those of ``index.TextIndex``: files are only added, a batch counts once its
``cells`` are there, and one that runs again replaces itself.

A search scores the cells nearest to each question first, which gives the
question a score that its k-th hit has at least. The angles of a cell's vectors to
its center bound the cosine that a question can have with any of them, so further
cells are read only where that bound reaches the score, and blocks in them
likewise. The result is exact: it is that of ``search.vector_search``. How many cells are
left out depends on the vectors: most of them where they form clusters, none where
they point evenly in all directions. ``probes`` gives up exactness and reads so many cells
for each question.

Neither questions nor vectors go through the driver. The questions of a cell are dealt
to lots of about ``LOT`` and meet the cell's blocks in a merge join by cell, so a cell that
holds a third of all vectors is many rows, which adaptive execution can split. Only the centers
and one row for each cell are held by tasks: ``MAX_CELLS`` and ``CENTER_VALUES`` bound them.

Vectors that are null, zero, of another length than the index's, or that hold null
or non-finite components are not added and, as questions, find nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.search import DIGITS, ranked
from quarry.tables import stage

#: Bounds of what all tasks hold: cells, and numbers in their centers.
MAX_CELLS, CENTER_VALUES = 4096, 4_000_000
#: Vectors that centers are learned on, about; the index holds all.
SAMPLE = 50_000
#: Vectors of a block, and questions of a cell that meet its blocks together.
BLOCK, LOT = 256, 256
#: Cells that are scored for a question before others are left out; more where these hold fewer than k.
FIRST_CELLS = 2
#: Folders of blocks in a batch, the same for all of an index's life: as few as the driver lists by itself, however many cells there are.
BUCKETS = 16
#: Room for rounding in bounds, in radians.
SLACK = 1e-7

_SCHEMAS = {
    "blocks": "cell int, ids array<long>, values array<double>, least double, most double",
    "cells": "cell int, n long, least double, most double",
    "deleted": "cell int, first long, gone array<long>",
}


def usable(vector: str | Column, dims: int) -> Column:
    """Whether an array has ``dims`` finite components that aren't all zero."""
    v = F.col(vector) if isinstance(vector, str) else vector
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(v) == dims) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


class VectorIndex:
    """The index in a folder."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "vec_id", vector_col: str = "embedding"):
        self.spark, self.path, self.id_col, self.vector_col = spark, path.rstrip("/"), id_col, vector_col

    def _exists(self, name: str) -> bool:
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def _table(self, name: str) -> DataFrame:
        """A table's rows in batches that count."""
        schema = _SCHEMAS[name] + ", batch int" + (", bucket int" if name == "blocks" else "")
        if not self._exists(name):
            return self.spark.createDataFrame([], schema)
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        return rows if name == "cells" else rows.filter(F.col("batch").isin(self.batches()))

    def batches(self) -> list[int]:
        """The numbers of the batches that are complete."""
        return sorted(r["batch"] for r in self._table("cells").select("batch").distinct().collect())

    def centers(self) -> np.ndarray:
        """The centers as unit vectors, a row for each cell; none before something was learned."""
        if not self._exists("centers/_SUCCESS"):
            return np.empty((0, 0))
        rows = self.spark.read.schema("cell int, center array<double>").parquet(f"{self.path}/centers").collect()
        return np.array([r["center"] for r in sorted(rows, key=lambda r: r["cell"])])

    def learn(self, vectors: DataFrame, cells: int | None = None) -> int:
        """Learn the centers by k-means over cosines, the square root of the
        number of vectors if ``cells`` isn't given. The index takes vectors of
        the length that most of them have. Returns the number of cells; ``add``
        calls this where nothing was learned."""
        if self.batches():
            raise ValueError("the centers of an index that holds vectors can't change")
        v = F.col(self.vector_col).cast("array<double>")
        rows = vectors.select(F.col(self.id_col).alias("id"), v.alias("v")).filter(usable("v", F.size("v")))
        most = rows.groupBy(F.size("v").alias("dims")).count().orderBy(F.desc("count"), "dims").first()
        if most is None:
            return 0
        dims, n = most["dims"], most["count"]
        cells = min(cells or round(n**0.5), n, MAX_CELLS, max(1, CENTER_VALUES // dims))
        share = min(1.0, SAMPLE / n)
        sample = rows.filter((F.size("v") == dims) & (F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)))
        sample = stage(sample.select("id", "v"), "vectors-sample")
        if cells > 1 and sample.count() > cells:
            model = KMeans(k=cells, distanceMeasure="cosine", maxIter=10, seed=1).fit(sample.select(array_to_vector("v").alias("features")))
            found = np.array(model.clusterCenters())
        else:
            found = np.array([r["v"] for r in rows.filter(F.size("v") == dims).orderBy("id").limit(cells).collect()])
        length = np.linalg.norm(found, axis=1, keepdims=True)
        found = (found / np.where(length > 0, length, 1))[length[:, 0] > 0]
        out = self.spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(found)], "cell int, center array<double>")
        out.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centers")
        return len(found)

    def add(self, vectors: DataFrame, batch: int | None = None) -> int:
        """Add vectors, whose ids must be new or deleted. Returns the batch's
        number, the next one if none is given."""
        batch = max(self.batches(), default=-1) + 1 if batch is None else batch
        centers = self.centers()
        if not len(centers) and self.learn(vectors):
            centers = self.centers()
        if not len(centers):
            return batch
        v = F.col(self.vector_col).cast("array<double>")
        rows = vectors.select(F.col(self.id_col).cast("long").alias("id"), v.alias("v")).filter(usable("v", centers.shape[1]))
        shared = self.spark.sparkContext.broadcast(centers)
        placed = stage(rows.mapInArrow(_placed(shared), "id long, v array<double>, cell int, near double"), "vectors-placed")
        order = ["cell", "near", "id"]
        packed = placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_packed, _SCHEMAS["blocks"])
        packed = packed.withColumn("bucket", self._bucket(len(centers)))
        packed.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/blocks/batch={batch}")
        stats = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("near").alias("least"), F.max("near").alias("most"))
        self._mark(batch, stats)
        shared.unpersist()
        return batch

    @staticmethod
    def _bucket(cells: int) -> Column:
        return F.floor(F.col("cell") * BUCKETS / F.lit(cells)).cast("int")

    def _mark(self, batch: int, stats: DataFrame) -> None:
        stats.select("cell", "n", "least", "most").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/cells/batch={batch}")

    def delete(self, ids: DataFrame) -> int:
        """Delete the vectors of the column of ids; those that aren't there don't matter."""
        batch = max(self.batches(), default=-1) + 1
        ids = ids.select(F.col(ids.columns[0]).cast("long").alias("id")).distinct()
        gone = self._living().select("cell", F.col("ids")[0].alias("first"), F.explode(F.array_except("ids", "gone")).alias("id")).join(ids, "id")
        gone = stage(gone.groupBy("cell", "first").agg(F.collect_list("id").alias("gone")), "vectors-deleted")
        gone.write.mode("overwrite").parquet(f"{self.path}/deleted/batch={batch}")
        none = F.lit(None).cast("double")
        self._mark(batch, gone.groupBy("cell").agg((-F.sum(F.size("gone"))).alias("n"), none.alias("least"), none.alias("most")))
        return batch

    def _living(self) -> DataFrame:
        """Blocks with ``gone``, the ids of them that were deleted later. A block
        is found by its cell and first id."""
        gone = self._table("deleted").select("cell", "first", "gone", F.col("batch").alias("until"))
        blocks = self._table("blocks").withColumn("first", F.col("ids")[0])
        if not self._exists("deleted"):
            return blocks.withColumn("gone", F.array().cast("array<long>"))
        # A block's deletions are at most as many as its ids in each time that they were added.
        later = blocks.select("cell", "first", "batch").join(gone, ["cell", "first"]).filter(F.col("until") > F.col("batch"))
        later = later.groupBy("cell", "first", "batch").agg(F.array_distinct(F.flatten(F.collect_list("gone"))).alias("gone"))
        return blocks.join(later, ["cell", "first", "batch"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<long>")))

    def search(self, queries: DataFrame, top_k: int, probes: int | None = None) -> DataFrame:
        """The best ``top_k`` vectors of each question (``query_id``, each once,
        and ``vector``): ``query_id``, ``doc_id``, ``score``, ``rank``. Exact,
        unless ``probes`` tells how many cells to read for each question."""
        shared = self._state()
        if shared is None:
            return self.spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
        asked = stage(self._asked(queries, shared).withColumn("floor", F.lit(-2.0)), "vectors-asked")
        early = stage(ranked(self._scored(asked, shared, top_k, probes, False), top_k), "vectors-early")
        if probes is not None:
            return early
        floor = early.filter(F.col("rank") == top_k).select("query_id", F.col("score").alias("floor"))
        rest = asked.drop("floor").join(floor, "query_id", "left").select("query_id", "v", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
        late = self._scored(rest, shared, top_k, None, True)
        return ranked(early.drop("rank").unionByName(late), top_k)

    def probed(self, queries: DataFrame, top_k: int) -> DataFrame:
        """``query_id`` and ``cells``: how many can hold one of its best ``top_k``, those
        of the first pass included. An exact search reads these, and a few
        more where the first pass finds a lower k-th score."""
        shared = self._state()
        if shared is None:
            return self.spark.createDataFrame([], "query_id long, cells long")
        floor = self.search(queries, top_k).filter(F.col("rank") == top_k).select("query_id", F.col("score").alias("floor"))
        asked = self._asked(queries, shared).join(floor, "query_id", "left").select("query_id", "v", F.coalesce("floor", F.lit(-2.0)).alias("floor"))
        schema = "query_id long, v array<double>, floor double, cell int"
        both = [asked.mapInArrow(_probes(shared, top_k, None, late), schema).select("query_id", "cell") for late in (False, True)]
        return both[0].unionByName(both[1]).groupBy("query_id").agg(F.count("*").alias("cells"))

    def _state(self):
        """The centers and how many vectors each cell has and how near they are, for all tasks; nothing for an empty index."""
        stats = self._table("cells").groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"))
        stats = stats.filter("n > 0").collect()
        if not stats:
            return None
        centers = self.centers()
        n, least, most = np.zeros(len(centers)), np.ones(len(centers)), np.ones(len(centers))
        for r in stats:
            n[r["cell"]], least[r["cell"]], most[r["cell"]] = r["n"], r["least"], r["most"]
        return self.spark.sparkContext.broadcast((centers, n, least, most))

    def _asked(self, queries: DataFrame, shared) -> DataFrame:
        rows = queries.select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>").alias("v"))
        return rows.filter(usable("v", shared.value[0].shape[1]))

    def _scored(self, asked: DataFrame, shared, top_k: int, probes: int | None, late: bool) -> DataFrame:
        """``query_id``, ``doc_id``, ``score`` of the best of the cells of a pass, by block."""
        schema = "query_id long, v array<double>, floor double, cell int"
        pairs = stage(asked.mapInArrow(_probes(shared, top_k, probes, late), schema), "vectors-probes")
        counts = pairs.groupBy("cell").agg(F.ceil(F.count("*") / LOT).cast("int").alias("lots"))  # a row for each cell at most
        wanted = [r["cell"] for r in counts.select("cell").collect()]
        lots = pairs.join(F.broadcast(counts), "cell").groupBy("cell", F.pmod(F.xxhash64("query_id"), F.col("lots")).alias("lot"))
        lots = lots.agg(F.collect_list(F.struct("query_id", "floor", "v")).alias("q"))
        lots = lots.select("cell", F.col("q.query_id").alias("query_ids"), F.col("q.floor").alias("floors"), F.flatten("q.v").alias("vectors"))
        cells = len(shared.value[0])
        buckets = sorted({cell * BUCKETS // cells for cell in wanted})
        blocks = self._living().filter(F.col("bucket").isin(buckets)).select("cell", "ids", "values", "least", "most", "gone")
        # Lots hold a question's vector once for each of its cells, which files of pairs hold in little room: Spark would
        # take them for small by the files' size and broadcast them through the driver.
        return lots.join(blocks.hint("merge"), "cell").mapInArrow(_nearest(shared, top_k), "query_id long, doc_id long, score double")


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _units(x: np.ndarray) -> np.ndarray:
    # Scaled first, so that squares of very large or small components stay finite.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def _reach(cosine: np.ndarray, least: np.ndarray, most: np.ndarray) -> np.ndarray:
    """The largest cosine that a question can have with a vector whose cosine to
    a center lies between ``least`` and ``most``, where its own is ``cosine``."""
    own, near, far = (np.arccos(np.clip(c, -1, 1)) for c in (cosine, most, least))
    return np.cos(np.maximum(0, np.maximum(own - far, near - own) - SLACK))


def _placed(shared) -> Callable:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = _units(_matrix(part.column(1), centers.shape[1]))
                cosines = x @ centers.T
                cell = cosines.argmax(axis=1)
                near = np.take_along_axis(cosines, cell[:, None], 1)[:, 0]
                yield pa.RecordBatch.from_arrays([part.column(0), _lists(x), pa.array(cell.astype(np.int32)), pa.array(near)], ["id", "v", "cell", "near"])

    return place


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of cell and cosine as blocks."""
    names = ["cell", "ids", "values", "least", "most"]

    def block(part: pa.Table) -> pa.RecordBatch:
        part = part.combine_chunks()
        ids, values, near = (part.column(c).combine_chunks() for c in ("id", "v", "near"))
        values = values.flatten()
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids, values)]
        return pa.RecordBatch.from_arrays([pa.array([part.column("cell")[0].as_py()], pa.int32()), *lists, near[:1], near[-1:]], names)

    held, cell = [], None
    for batch in batches:
        cells = batch.column(batch.schema.get_field_index("cell")).to_numpy()
        at = 0
        while at < batch.num_rows:
            if held and cell != cells[at]:
                yield block(pa.Table.from_batches(held))
                held = []
            cell = cells[at]
            size = sum(b.num_rows for b in held)
            end = min(int(np.searchsorted(cells, cell, "right")), at + BLOCK - size)
            held.append(batch.slice(at, end - at))
            at = end
            if size + held[-1].num_rows == BLOCK:
                yield block(pa.Table.from_batches(held))
                held = []
    if held:
        yield block(pa.Table.from_batches(held))


def _probes(shared, top_k: int, probes: int | None, late: bool) -> Callable:
    """A row for each question and cell of a pass. The first pass takes the
    nearest cells until they hold ``top_k`` vectors, or ``probes`` cells; the
    late one what can still reach a question's floor."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers, n, least, most = shared.value
        full = np.flatnonzero(n > 0)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                cosines = _units(_matrix(part.column(1), centers.shape[1])) @ centers[full].T
                order = np.argsort(-cosines, axis=1, kind="stable")
                # Cells before which fewer than top_k vectors were met, and the first few.
                sizes = n[full][order]
                place = np.arange(len(full))[None, :]
                nearest = (np.cumsum(sizes, axis=1) - sizes < top_k) | (place < FIRST_CELLS) if probes is None else np.broadcast_to(place < probes, order.shape)
                chosen = np.zeros(order.shape, bool)
                np.put_along_axis(chosen, order, nearest, 1)
                if late:
                    floor = part.column(2).to_numpy()[:, None]
                    chosen = ~chosen & (_reach(cosines, least[full], most[full]) >= floor - 10.0**-DIGITS)
                row, cell = np.nonzero(chosen)
                taken = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(full[cell].astype(np.int32))], ["query_id", "v", "floor", "cell"])

    return choose


def _nearest(shared, top_k: int) -> Callable:
    """The best ``top_k`` of a block for each question of a lot, of scores that reach the question's floor."""

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centers = shared.value[0]
        dims = centers.shape[1]
        for batch in batches:
            get = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                numbers = lambda c: get[c][i].values.to_numpy(zero_copy_only=False)  # noqa: E731, B023
                q, floor = _units(numbers("vectors").reshape(-1, dims)), numbers("floors")
                reach = _reach(q @ centers[get["cell"][i].as_py()], get["least"][i].as_py(), get["most"][i].as_py())
                can = np.flatnonzero(reach >= floor - 10.0**-DIGITS)
                ids, x, gone = numbers("ids"), numbers("values").reshape(-1, dims), numbers("gone")
                if len(gone):
                    left = ~np.isin(ids, gone)
                    ids, x = ids[left], x[left]
                if not len(can) or not len(ids):
                    continue
                scores = np.round(q[can] @ x.T, DIGITS) + 0.0
                top = np.lexsort((np.broadcast_to(ids, scores.shape), -scores), axis=1)[:, :top_k]
                scores = np.take_along_axis(scores, top, 1)
                keep = scores >= floor[can][:, None]
                asked = np.broadcast_to(numbers("query_ids")[can][:, None], scores.shape)
                yield pa.RecordBatch.from_arrays([pa.array(asked[keep]), pa.array(ids[top][keep]), pa.array(scores[keep])], ["query_id", "doc_id", "score"])

    return best
