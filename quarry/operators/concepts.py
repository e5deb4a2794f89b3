"""Graphs whose relations are nodes of their own, as edges between concepts, and small views of them.

nodes: ``node``, ``kind``, ``label`` and, where the kind has "triple" in it,
``relation``, ``subject_id``, ``subject_name``, ``object_id``, ``object_name``
(any of them null). edges: ``source``, ``relation``, ``target``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.tables import stage

#: Relations that only hold a graph together, and how many nodes a view shows.
STRUCTURAL = ("SUBJECT_OF", "OBJECT_OF", "EDGE", "RELATED_TO")
VIEW = 18


def concept_key(label: Column, node: Column) -> Column:
    """Letters, digits and CJK characters of a label in lower case; the node's id where there are none."""
    key = F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), r"[^a-z0-9一-鿿]+", "")
    return F.coalesce(F.nullif(key, F.lit("")), node)


def _is_triple() -> Column:
    return F.lower(F.coalesce("kind", F.lit(""))).contains("triple")


def concept_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Different edges ``source``, ``relation``, ``target`` between concepts, without loops.

    A triple node becomes an edge from its subject to its object. Either end is
    told by an edge (``SUBJECT_OF`` comes from the subject, ``OBJECT_OF`` goes to
    the object; the smallest id of several), else by the property with its id,
    else by a node with its name, else it is a concept made from that name. An id
    without a node counts by the name, if there is one. Triples without an end
    and structural relations give no edge. Edges between other nodes stay.

    Both ends of all triples are rows of one table with a key that is never null,
    so they are looked up in one join, and many triples without a name don't meet."""
    triple = nodes.filter(_is_triple() & F.col("node").isNotNull())
    ends = {"subject": ("SUBJECT_OF", "target", "source"), "object": ("OBJECT_OF", "source", "target")}
    clue = lambda side, rank, space, ref, name: F.struct(F.lit(side).alias("side"), F.lit(rank).alias("rank"), F.lit(space).alias("space"), ref.cast("string").alias("ref"), name.alias("name"))
    own = F.explode(F.array(*(clue(s, r, k, F.col(f"{s}_{c}"), F.col(f"{s}_name")) for s in ends for r, k, c in ((1, "id", "id"), (2, "name", "name")))))
    clues = triple.select("node", own.alias("c"))
    relation = F.upper(F.coalesce("relation", F.lit("")))
    for side, (name, at, to) in ends.items():
        told = edges.filter(relation == name).select(F.col(at).cast("string").alias("node"), clue(side, 0, "id", F.col(to), F.lit(None).cast("string")).alias("c"))
        clues = clues.unionByName(told)
    clues = clues.select(F.col("node").cast("string").alias("node"), "c.*").filter("node is not null and coalesce(trim(ref), '') <> ''")
    # The name comes along for an id that no node has.
    best = clues.groupBy("node", "side").agg(F.min(F.struct("rank", "ref", "space")).alias("b"), F.max("name").alias("name")).select("node", "side", "b.space", "b.ref", "name")

    plain = nodes.filter(~_is_triple() & F.col("node").isNotNull()).select(F.col("node").cast("string").alias("node"), "label")
    keyed = plain.select("node", "label", concept_key(F.col("label"), F.col("node")).alias("key"))
    by_id = keyed.groupBy(F.lit("id").alias("space"), F.col("node").alias("ref")).agg(F.min("key").alias("key"))
    by_name = keyed.filter("trim(label) <> ''").groupBy(F.lit("name").alias("space"), F.col("label").alias("ref")).agg(F.min_by("key", "node").alias("key"))
    found = best.join(by_id.unionByName(by_name), ["space", "ref"], "left")
    key = F.coalesce("key", concept_key(F.coalesce("name", F.when(F.col("space") == "name", F.col("ref"))), F.col("ref")))
    sides = found.groupBy("node").agg(*(F.max(F.when(F.col("side") == s, key)).alias(c) for s, c in (("subject", "source"), ("object", "target"))))
    said = triple.groupBy(F.col("node").cast("string").alias("node")).agg(F.min(F.coalesce(F.nullif(F.trim("relation"), F.lit("")), F.nullif(F.trim("label"), F.lit("")))).alias("relation"))
    made = sides.join(said, "node").select("source", F.upper(F.coalesce("relation", F.lit("RELATED_TO"))).alias("relation"), "target")

    ids = by_id.select(F.col("ref").alias("node"), "key")
    direct = edges.filter(~relation.isin("", *STRUCTURAL)).select(F.col("source").cast("string").alias("a"), relation.alias("relation"), F.col("target").cast("string").alias("b"))
    direct = direct.distinct().join(ids.select(F.col("node").alias("a"), F.col("key").alias("source")), "a").join(ids.select(F.col("node").alias("b"), F.col("key").alias("target")), "b")
    both = made.unionByName(direct.select("source", "relation", "target"))
    return both.filter("source <> target").filter(~F.col("relation").isin(*STRUCTURAL)).distinct()


def concept_view(edges: DataFrame, centers: DataFrame, most: int = VIEW) -> DataFrame:
    """The first ``most`` concepts breadth first around each center
    (``query_id``, ``concept``), edges taken in both directions: ``query_id``,
    ``concept``, ``depth`` and ``position``. Neighbours of one concept go by name.

    No more than ``most`` neighbours of a concept can be used: those that are
    shown already are fewer than ``most`` with the concept itself. So a hub costs
    ``most`` rows, and a round is a join of at most ``most`` rows a question. There
    are fewer than ``most`` rounds, as each adds a concept to some question."""
    ways = edges.select(F.col("source").alias("concept"), F.col("target").alias("next")).unionByName(edges.select(F.col("target").alias("concept"), F.col("source").alias("next")))
    ways = ways.filter("concept <> next").distinct()
    first = F.row_number().over(Window.partitionBy("concept").orderBy("next"))
    ways = stage(ways.withColumn("n", first).filter(F.col("n") <= most).drop("n"), "ways")
    found = centers.filter("query_id is not null and concept is not null").select("query_id", "concept").distinct()
    found = found.select("query_id", "concept", F.lit(0).alias("depth"), F.row_number().over(Window.partitionBy("query_id").orderBy("concept")).alias("position"))
    found = stage(found.filter(F.col("position") <= most), "view")
    for depth in range(1, most):
        front = found.filter(F.col("depth") == depth - 1)
        step = front.join(ways, "concept").groupBy("query_id", F.col("next").alias("concept")).agg(F.min("position").alias("parent"))
        step = step.join(found, ["query_id", "concept"], "left_anti").join(found.groupBy("query_id").agg(F.count("*").alias("shown")), "query_id")
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("parent", "concept"))
        step = step.withColumn("place", place).filter(F.col("place") + F.col("shown") <= most)
        step = stage(step.select("query_id", "concept", F.lit(depth).alias("depth"), (F.col("place") + F.col("shown")).cast("int").alias("position")), "view")
        if step.isEmpty():
            break
        found = found.unionByName(step)
    return found


def view_edges(edges: DataFrame, view: DataFrame) -> DataFrame:
    """The edges whose ends a question's view shows both: ``query_id``, ``source``, ``relation``, ``target``."""
    ends = [view.select("query_id", F.col("concept").alias(side)) for side in ("source", "target")]
    return edges.join(ends[0], "source").join(ends[1], ["query_id", "target"]).select("query_id", "source", "relation", "target")
