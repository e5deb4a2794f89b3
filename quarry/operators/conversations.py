"""Conversation trees: messages (``conv_id``, ``id``, ``parent_id``, ``pos``) and their paths.

``pos`` orders siblings; a message without a parent is a root. Walks double
their pointers, so their rounds grow with the logarithm of the depth. Trees may
be of any size and depth; a walk that comes to messages whose parents go round in a circle is
an error, circles elsewhere don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.tables import stage


def _walk(heads: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of ``heads`` (``conv_id``, ``id``, ``depth`` and others) and all
    that come below them by ``links`` (``conv_id``, ``id``, ``next_id``).

    Pointers are doubled: each round knows every message's ancestor 1, 2, 4 ...
    levels up, adds the messages whose ancestor is found already, and joins the
    pointers with themselves. Rounds are as many as the depth has binary digits.
    Below a circle pointers never end; no way without one is longer than the links
    of a conversation, so the last round looks only for one that is."""
    kind = heads.schema["id"].dataType
    up = links.filter("id is not null and next_id is not null").select("conv_id", F.col("next_id").cast(kind).alias("id"), F.col("id").cast(kind).alias("above")).distinct()
    up, found, step = stage(up, "pointers"), stage(heads, "walk"), 1
    most = up.groupBy("conv_id").count().agg(F.max("count")).first()[0] or 0
    while not up.isEmpty():
        below = up.select("conv_id", F.col("above").alias("id"), F.col("id").alias("below"))
        more = found.join(below, ["conv_id", "id"]).withColumns({"id": F.col("below"), "depth": (F.col("depth") + step).cast(heads.schema["depth"].dataType)})
        if step > most:
            if not more.isEmpty():
                raise ValueError("messages whose parents go round in a circle")
            break
        found = stage(found.unionByName(more.select(*found.columns)), "walk")
        higher = up.select("conv_id", F.col("id").alias("above"), F.col("above").alias("higher"))
        up = stage(up.join(higher, ["conv_id", "above"]).select("conv_id", "id", F.col("higher").alias("above")), "pointers")
        step *= 2
    return found


def backfill_links(messages: DataFrame, order: list[str]) -> DataFrame:
    """Linear conversations as a tree: the parent is the message before, the active child the one after."""
    w = Window.partitionBy("conv_id").orderBy(*order)
    return messages.withColumns({"parent_id": F.lag("id").over(w), "active_child_id": F.lead("id").over(w)})


def siblings(messages: DataFrame) -> DataFrame:
    """``sibling`` and ``siblings``: which of how many children of a parent."""
    w = Window.partitionBy("conv_id", "parent_id")
    return messages.withColumns({"sibling": F.row_number().over(w.orderBy("pos", "id")), "siblings": F.count("*").over(w)})


def chosen_children(messages: DataFrame) -> DataFrame:
    """The child that a path goes on with: the active one if it is a child, else the last."""
    kids = messages.alias("k").join(messages.select("conv_id", F.col("id").alias("pid"), F.col("active_child_id").alias("active")).alias("p"), ["conv_id"]).filter("k.parent_id = p.pid")
    rank = F.struct((F.coalesce(F.col("k.id") == F.col("p.active"), F.lit(False))).alias("active"), F.col("k.pos").alias("pos"), F.col("k.id").alias("id"))
    return kids.groupBy("conv_id", F.col("k.parent_id").alias("parent_id")).agg(F.max(rank)["id"].alias("child_id"))


def active_paths(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``depth``, ``id`` along each conversation's active path,
    which starts at its last root (or ``is_active_root``)."""
    roots = messages.filter("parent_id is null").groupBy("conv_id").agg(F.max(F.struct("pos", "id"))["id"].alias("id"))
    links = chosen_children(messages).select("conv_id", F.col("parent_id").alias("id"), F.col("child_id").alias("next_id"))
    return _walk(roots.select("conv_id", F.lit(0).alias("depth"), "id"), links)


def subtrees(messages: DataFrame, heads: DataFrame) -> DataFrame:
    """All messages at or below each of ``heads`` (``conv_id``, ``head_id``) with their depth."""
    links = messages.select("conv_id", F.col("parent_id").alias("id"), F.col("id").alias("next_id"))
    return _walk(heads.select("conv_id", "head_id", F.col("head_id").alias("id"), F.lit(0).alias("depth")), links)


def delete_branches(messages: DataFrame, heads: DataFrame) -> DataFrame:
    """The messages left when the subtrees of ``heads`` go; a parent whose
    active child went points to the sibling before it, else after it."""
    gone = subtrees(messages, heads).select("conv_id", "id").distinct()
    w = Window.partitionBy("conv_id", "parent_id").orderBy("pos", "id")
    near = messages.select("conv_id", F.col("id").alias("active_child_id"), F.coalesce(F.lag("id").over(w), F.lead("id").over(w)).alias("next_active"))
    left = messages.join(gone, ["conv_id", "id"], "left_anti")
    lost = gone.withColumnRenamed("id", "active_child_id").withColumn("lost", F.lit(True))
    rows = left.join(near, ["conv_id", "active_child_id"], "left").join(lost, ["conv_id", "active_child_id"], "left")
    return rows.withColumn("active_child_id", F.when(F.col("lost"), F.col("next_active")).otherwise(F.col("active_child_id"))).drop("next_active", "lost")


def append_turns(messages: DataFrame, turns: DataFrame) -> DataFrame:
    """Add messages below their parents and point the parents at them; the last one added wins."""
    last = turns.groupBy("conv_id", "parent_id").agg(F.max(F.struct("pos", "id"))["id"].alias("new_child"))
    old = messages.join(last.withColumnRenamed("parent_id", "id"), ["conv_id", "id"], "left")
    old = old.withColumn("active_child_id", F.coalesce("new_child", "active_child_id")).drop("new_child")
    return old.unionByName(turns, allowMissingColumns=True)


def nested(messages: DataFrame) -> DataFrame:
    """Each parent with its children in order."""
    child = F.struct("pos", "id", "role")
    kids = messages.groupBy("conv_id", "parent_id").agg(F.transform(F.sort_array(F.collect_list(child)), lambda c: c["id"]).alias("children"))
    return kids


def message_counts(conversations: DataFrame, messages: DataFrame) -> DataFrame:
    """Each conversation with the number of its messages, also if it has none."""
    n = messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"))
    return conversations.join(n, "conv_id", "left").fillna(0, ["n_messages"])


def recent_history(messages: DataFrame, turns: int = 8, user_chars: int = 1200, other_chars: int = 500) -> DataFrame:
    """The last messages of each conversation as one text, each cut to its role's length."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("pos"), F.desc("id"))
    rows = messages.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= turns)
    limit = F.when(F.col("role") == "user", F.lit(user_chars)).otherwise(F.lit(other_chars))
    line = F.concat(F.col("role"), F.lit(": "), F.substring(F.coalesce(F.col("text"), F.lit("")), F.lit(1), limit))
    lines = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("back")).alias("at"), line.alias("line")))).alias("lines"))
    return lines.select("conv_id", F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("history"))


def age_bucket(at: Column, now: Column) -> Column:
    """today, week, month or older, by days before ``now``."""
    days = F.datediff(now, at)
    return F.when(days < 1, "today").when(days < 7, "week").when(days < 30, "month").otherwise("older")


def conversation_list(conversations: DataFrame, messages: DataFrame, user: Column | None = None) -> DataFrame:
    """Conversations (``conv_id``, ``user_id``, ``updated_at``), of one user if
    given, with their number of messages; the last changed one has ``place`` 1 of its user's."""
    rows = conversations if user is None else conversations.filter(F.col("user_id") == user)
    counts = messages.groupBy("conv_id").agg(F.count("*").alias("n_messages"))
    order = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "conv_id")
    return rows.join(counts, "conv_id", "left").withColumns({"n_messages": F.coalesce("n_messages", F.lit(0)), "place": F.row_number().over(order)})


def shared_paths(shares: DataFrame, messages: DataFrame) -> DataFrame:
    """shares: ``token``, ``conv_id``. What each shared link shows: the active path of its conversation."""
    wanted = messages.join(shares.select("conv_id").distinct(), "conv_id", "left_semi")
    return shares.join(active_paths(wanted), "conv_id").select("token", "conv_id", "depth", "id")
