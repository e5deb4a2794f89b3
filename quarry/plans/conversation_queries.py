"""Conversation trees over ``conversations``, paging and buckets over ``orders`` and ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quarry.operators import activity as A
from quarry.operators import conversations as C
from quarry.plans.search_queries import table


def flat(spark, sf_dir):
    """One message for each turn: of repeated ones the first by role and text."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m"))
    return rows.select("conv_id", F.col("turn").alias("id"), F.col("turn").alias("pos"), "m.role", "m.text")


def tree(spark, sf_dir):
    """Branching conversations made from the flat ones: message n answers message (n - 1) / 2."""
    parent = F.when(F.col("id") > 0, F.floor((F.col("id") - 1) / 2))
    first = F.col("id") * 2 + 1
    rows = flat(spark, sf_dir).withColumns({"parent_id": parent, "active_child_id": F.when(F.col("id") % 3 == 0, first)})
    return rows


def tree_backfill(spark, sf_dir):
    return C.backfill_links(flat(spark, sf_dir), ["pos", "id"]).select("conv_id", "id", "parent_id", "active_child_id")


def tree_active_path(spark, sf_dir):
    return C.active_paths(tree(spark, sf_dir))


def tree_subtree(spark, sf_dir):
    rows = tree(spark, sf_dir)
    return C.subtrees(rows, rows.filter("id in (1, 2)").select("conv_id", F.col("id").alias("head_id")))


def tree_siblings(spark, sf_dir):
    return C.siblings(tree(spark, sf_dir)).select("conv_id", "id", "sibling", "siblings")


def tree_delete(spark, sf_dir):
    rows = tree(spark, sf_dir)
    return C.delete_branches(rows, rows.filter("id = 3").select("conv_id", F.col("id").alias("head_id"))).select("conv_id", "id", "active_child_id")


def tree_children(spark, sf_dir):
    return C.nested(tree(spark, sf_dir)).select("conv_id", "parent_id", F.array_join("children", ",").alias("children"))


def conversation_counts(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return C.message_counts(rows.select("conv_id").distinct(), rows.filter("role = 'assistant'"))


def conversation_history(spark, sf_dir):
    return C.recent_history(flat(spark, sf_dir))


NOW = "1998-06-01 00:00:00"


def age_buckets(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    now = rows.agg(F.max("ts").alias("now"))
    bucket = C.age_bucket(F.col("ts"), F.col("now"))
    return rows.crossJoin(F.broadcast(now)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))  # one row beside the events


def feedback_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("category", F.when(F.col("toxic") == 1, "unsafe").when(F.col("quality") == 0, "poor").otherwise("good"))
    return A.category_summary(rows, "category", ("good", "poor", "unsafe", "unreviewed"))


def paged_orders(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").like("%1-%"))
    return A.page(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], limit=500, offset=7).select("o_orderkey", "o_orderdate")


def filtered_total(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").filter((F.col("o_orderstatus") == "O") & F.col("o_orderpriority").like("%1-%"))
    return rows.agg(F.count("*").alias("total"))


def stage_latency(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("stage"), F.col("value").alias("seconds"))
    out = A.latency_by_stage(rows)
    return out.select("stage", "n", F.round("seconds", 4).alias("seconds"), F.round("share", 6).alias("share"))


def rate_limit_window(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), "ts")
    return A.calls_in_window(rows, 3600).select("event_id", "calls")


def rate_limit(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), "ts")
    return A.rate_limited(rows, limit=2, seconds=3600 * 24).select("event_id", "allowed")


def cache_hits(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat_ws("|", "user_id", "event_type").alias("key"), "ts")
    return A.cache_hits(rows, ttl_seconds=86400).select("event_id", "hit")


def event_windows(spark, sf_dir):
    return A.windowed_counts(table(spark, sf_dir, "events")).select("start", "event_type", "n", F.round("total", 4).alias("total"))


def event_sessions(spark, sf_dir):
    return A.sessions(table(spark, sf_dir, "events"), "6 hours").select("user_id", "start", "n")


def provider_status(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return A.provider_status(rows.select(F.col("event_type").alias("provider"), (F.col("value") < 5).alias("failed"), F.floor("value").cast("long").alias("records")))


_FLAT = "f AS (SELECT conv_id, turn AS id, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY role NULLS FIRST, text NULLS FIRST) = 1)"
_TREE = f"{_FLAT}, t AS (SELECT *, CASE WHEN id > 0 THEN (id - 1) // 2 END AS parent_id, CASE WHEN id % 3 = 0 THEN id * 2 + 1 END AS active_child_id FROM f)"

QUERIES = {
    "tree_backfill": tree_backfill,
    "tree_active_path": tree_active_path,
    "tree_subtree": tree_subtree,
    "tree_siblings": tree_siblings,
    "tree_delete": tree_delete,
    "tree_children": tree_children,
    "conversation_counts": conversation_counts,
    "conversation_history": conversation_history,
    "age_buckets": age_buckets,
    "feedback_summary": feedback_summary,
    "paged_orders": paged_orders,
    "filtered_total": filtered_total,
    "stage_latency": stage_latency,
    "rate_limit_window": rate_limit_window,
    "rate_limit": rate_limit,
    "cache_hits": cache_hits,
    "event_windows": event_windows,
    "event_sessions": event_sessions,
    "provider_status": provider_status,
}

ORACLE_SQL = {
    "tree_backfill": f"WITH {_FLAT} SELECT conv_id, id, lag(id) OVER w AS parent_id, lead(id) OVER w AS active_child_id FROM f WINDOW w AS (PARTITION BY conv_id ORDER BY id)",
    "tree_active_path": f"""
WITH RECURSIVE {_TREE},
c AS (
  SELECT k.conv_id, k.parent_id, arg_max(k.id, (CASE WHEN k.id = p.active_child_id THEN 1 ELSE 0 END) * 1000000 + k.id) AS child
  FROM t k JOIN t p ON k.conv_id = p.conv_id AND k.parent_id = p.id GROUP BY ALL),
path AS (
  SELECT conv_id, 0 AS depth, max(id) AS id FROM t WHERE parent_id IS NULL GROUP BY conv_id
  UNION ALL SELECT p.conv_id, p.depth + 1, c.child FROM path p JOIN c ON p.conv_id = c.conv_id AND p.id = c.parent_id)
SELECT conv_id, depth, id FROM path""",
    "tree_subtree": f"""
WITH RECURSIVE {_TREE},
b AS (
  SELECT conv_id, id AS head_id, id, 0 AS depth FROM t WHERE id IN (1, 2)
  UNION ALL SELECT b.conv_id, b.head_id, t.id, b.depth + 1 FROM b JOIN t ON b.conv_id = t.conv_id AND b.id = t.parent_id)
SELECT conv_id, head_id, id, depth FROM b""",
    "tree_siblings": f"WITH {_TREE} SELECT conv_id, id, row_number() OVER (PARTITION BY conv_id, parent_id ORDER BY id) AS sibling, count(*) OVER (PARTITION BY conv_id, parent_id) AS siblings FROM t",
    "tree_delete": f"""
WITH RECURSIVE {_TREE},
b AS (
  SELECT conv_id, id FROM t WHERE id = 3
  UNION ALL SELECT b.conv_id, t.id FROM b JOIN t ON b.conv_id = t.conv_id AND b.id = t.parent_id),
n AS (SELECT conv_id, id, coalesce(lag(id) OVER w, lead(id) OVER w) AS near FROM t WINDOW w AS (PARTITION BY conv_id, parent_id ORDER BY id))
SELECT t.conv_id, t.id, CASE WHEN g.id IS NOT NULL THEN n.near ELSE t.active_child_id END AS active_child_id
FROM t ANTI JOIN b ON t.conv_id = b.conv_id AND t.id = b.id
LEFT JOIN b g ON t.conv_id = g.conv_id AND t.active_child_id = g.id
LEFT JOIN n ON t.conv_id = n.conv_id AND t.active_child_id = n.id""",
    "tree_children": f"WITH {_TREE} SELECT conv_id, parent_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY id) AS children FROM t GROUP BY ALL",
    "conversation_counts": "SELECT conv_id, count(*) FILTER (role = 'assistant') AS n_messages FROM conversations GROUP BY conv_id",
    "conversation_history": f"""
WITH {_FLAT},
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY id DESC) AS back FROM f QUALIFY back <= 8)
SELECT conv_id, string_agg(role || ': ' || substr(coalesce(text, ''), 1, CASE WHEN role = 'user' THEN 1200 ELSE 500 END), chr(10) ORDER BY back DESC) AS history FROM b GROUP BY conv_id""",
    "age_buckets": """
WITH e AS (SELECT date_diff('day', CAST(ts AS DATE), CAST((SELECT max(ts) FROM events) AS DATE)) AS d FROM events)
SELECT CASE WHEN d < 1 THEN 'today' WHEN d < 7 THEN 'week' WHEN d < 30 THEN 'month' ELSE 'older' END AS bucket, count(*) AS n FROM e GROUP BY ALL""",
    "feedback_summary": """
WITH c AS (SELECT CASE WHEN toxic = 1 THEN 'unsafe' WHEN quality = 0 THEN 'poor' ELSE 'good' END AS category FROM labels),
k AS (SELECT category FROM c UNION SELECT unnest(['good', 'poor', 'unsafe', 'unreviewed']))
SELECT k.category, count(c.category) AS n, (SELECT count(*) FROM c) AS total FROM k LEFT JOIN c ON k.category = c.category GROUP BY k.category""",
    "paged_orders": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '%1-%' ORDER BY o_orderdate DESC, o_orderkey LIMIT 200 OFFSET 7",
    "filtered_total": "SELECT count(*) AS total FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority LIKE '%1-%'",
    "stage_latency": "SELECT event_type AS stage, count(*) AS n, round(sum(value), 4) AS seconds, round(sum(value) / (SELECT sum(value) FROM events), 6) AS share FROM events GROUP BY event_type",
    "rate_limit_window": "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS calls FROM events",
    "event_windows": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "event_sessions": """
WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "provider_status": """
WITH p AS (SELECT event_type AS provider, value < 5 AS failed, CAST(floor(value) AS BIGINT) AS records FROM events),
c AS (SELECT provider, count(*) AS queries, CAST(sum(CASE WHEN failed THEN 0 ELSE records END) AS BIGINT) AS records, count(*) FILTER (failed) AS errors FROM p GROUP BY provider)
SELECT *, CASE WHEN errors = queries THEN 'failed' WHEN errors > 0 THEN 'degraded' WHEN records = 0 THEN 'empty' ELSE 'ok' END AS state FROM c""",
    "rate_limit": """
WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
s AS (
  SELECT event_id, user_id, r, t AS last, CAST(NULL AS BIGINT) AS second, true AS allowed FROM e WHERE r = 1
  UNION ALL
  SELECT e.event_id, e.user_id, e.r, CASE WHEN ok THEN e.t ELSE last END, CASE WHEN ok THEN last ELSE second END, ok
  FROM (SELECT s.user_id, s.r, s.last, s.second, e.event_id, e.t, (s.second IS NULL OR e.t - s.second > 86400000000) AS ok FROM s JOIN e ON s.user_id = e.user_id AND e.r = s.r + 1) x
  JOIN e ON x.event_id = e.event_id)
SELECT event_id, allowed FROM s""",
    "cache_hits": """
WITH RECURSIVE e AS (SELECT event_id, user_id || '|' || event_type AS key, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events),
s AS (
  SELECT event_id, key, r, t AS stored, false AS hit FROM e WHERE r = 1
  UNION ALL
  SELECT e.event_id, e.key, e.r, CASE WHEN e.t - s.stored <= 86400000000 THEN s.stored ELSE e.t END, e.t - s.stored <= 86400000000 FROM s JOIN e ON s.key = e.key AND e.r = s.r + 1)
SELECT event_id, hit FROM s""",
}
