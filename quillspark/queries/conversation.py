"""Conversation windows over the messages table."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.text import memory_entry
from quillspark.operators import conversations as C
from quillspark.operators import relational as R
from quillspark.queries import query, table


@query("SELECT conv_id, count(*) AS n_messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id ORDER BY last_turn DESC, conv_id LIMIT 20 OFFSET 10")
def conversation_page(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"), F.max("turn").alias("last_turn"))
    return R.page(rows, [F.desc("last_turn"), "conv_id"], 10, 20)


@query("SELECT c_custkey, count(o_orderkey) AS message_count, count(DISTINCT n_nationkey) AS file_count, max(o_orderdate) AS last_at FROM customer LEFT JOIN orders ON c_custkey = o_custkey LEFT JOIN nation ON n_regionkey = c_nationkey % 5 GROUP BY c_custkey")
def conversation_stats(spark, sf_dir):
    """The statistics view as it is written: two left joins, so the count of the first multiplies with the second."""
    c, o, n = (table(spark, sf_dir, t) for t in ("customer", "orders", "nation"))
    both = c.join(o, c.c_custkey == o.o_custkey, "left").join(n, n.n_regionkey == c.c_nationkey % 5, "left")
    return both.groupBy("c_custkey").agg(F.count("o_orderkey").alias("message_count"), F.countDistinct("n_nationkey").alias("file_count"), F.max("o_orderdate").alias("last_at"))


@query("SELECT c_custkey, coalesce(m, 0) AS message_count, coalesce(f, 0) AS file_count, last_at FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS m, max(o_orderdate) AS last_at FROM orders GROUP BY 1) ON c_custkey = o_custkey LEFT JOIN (SELECT n_regionkey, count(*) AS f FROM nation GROUP BY 1) ON n_regionkey = c_nationkey % 5")
def conversation_stats_safe(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") % 5).alias("n_regionkey"))
    m = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("m"), F.max("o_orderdate").alias("last_at"))
    f = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.count(F.lit(1)).alias("f"))
    return c.join(m, "c_custkey", "left").join(f, "n_regionkey", "left").select("c_custkey", F.coalesce("m", F.lit(0)).alias("message_count"), F.coalesce("f", F.lit(0)).alias("file_count"), "last_at")


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 5 AND trim(text) <> ''")
def history_last_n(spark, sf_dir):
    return C.last_messages(table(spark, sf_dir, "conversations"), 5).select("conv_id", "turn", "role", "position")


@query("SELECT conv_id, turn, running_chars FROM (SELECT *, sum(length(text)) OVER (PARTITION BY conv_id, role = 'system' ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS running_chars FROM conversations) WHERE role = 'system' OR running_chars <= 900")
def budget_truncate(spark, sf_dir):
    return C.within_budget(table(spark, sf_dir, "conversations"), 900).select("conv_id", "turn", "running_chars")


_FIRST = "(SELECT conv_id, arg_min(text, turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id)"


@query(
    f"""WITH x AS (SELECT c.*, q, role = 'user' AND trim(text) = trim(q) AND coalesce(lead(role) OVER w, '') = 'assistant' AS pair FROM conversations c JOIN {_FIRST} USING (conv_id) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
        y AS (SELECT *, role = 'assistant' AND coalesce(lag(pair) OVER (PARTITION BY conv_id ORDER BY turn), false) AS answer FROM x) SELECT conv_id, turn FROM y WHERE NOT pair AND NOT answer"""
)
def sanitize_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    first = rows.filter("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("q"))
    return C.without_repeats(rows.join(first, "conv_id"), F.col("q")).select("conv_id", "turn")


@query(
    """WITH x AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) SELECT a.conv_id, a.turn AS deactivate_turn, b.turn AS ask_turn FROM x a JOIN x b USING (conv_id) WHERE a.rn = 1 AND b.rn = 2 AND a.role = 'assistant' AND b.role = 'user'"""
)
def regenerate_pick(spark, sf_dir):
    return C.regenerate(table(spark, sf_dir, "conversations"))


@query(
    """SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || ': ' || text, chr(10) ORDER BY turn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations) WHERE rn <= 4 AND trim(text) <> '' GROUP BY conv_id"""
)
def extraction_context(spark, sf_dir):
    return C.joined_context(table(spark, sf_dir, "conversations"), 4)


@query(
    """SELECT conv_id, turn, printf('[%d] **%s** (relevance: %.2f, %s):', turn, upper(role), turn / 8.0, 't') || chr(10) || CASE WHEN length(text) > 300 THEN substr(text, 1, 297) || '...' ELSE text END || chr(10) || chr(10) AS entry FROM conversations"""
)
def memory_context(spark, sf_dir):
    entry = memory_entry(F.col("turn"), F.col("role"), F.col("turn") / 8.0, F.lit("t"), F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", entry.alias("entry"))


@query("SELECT conv_id, turn FROM conversations WHERE NOT (turn % 2 = 0 AND conv_id % 3 = 0)")
def unindexed_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations")
    return C.unindexed(rows, rows.filter("turn % 2 = 0 and conv_id % 3 = 0"), ["conv_id", "turn"]).select("conv_id", "turn")


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations), t AS (SELECT conv_id, max(role) FILTER (rn = 1) AS last, max(role) FILTER (rn = 2) AS before, max(turn) FILTER (rn = 1) AS turn FROM r GROUP BY 1),
       g AS (SELECT conv_id, turn FROM t WHERE last = 'assistant' AND before = 'user') SELECT conv_id, turn, role FROM conversations WHERE (conv_id, turn) NOT IN (SELECT conv_id, turn FROM g)"""
)
def active_messages(spark, sf_dir):
    """The rows that are left active when every conversation asks its last answer anew."""
    rows = table(spark, sf_dir, "conversations")
    gone = C.regenerate(rows).select("conv_id", F.col("deactivate_turn").alias("turn"), F.lit(True).alias("gone"))
    marked = rows.join(gone, ["conv_id", "turn"], "left").withColumn("is_active", F.col("gone").isNull())
    return marked.filter("is_active").select("conv_id", "turn", "role")


@query("SELECT conv_id, turn, CASE WHEN turn % 2 = 0 AND conv_id % 3 = 0 THEN 'old' ELSE md5(role || ':' || text) END AS entry FROM conversations")
def message_index(spark, sf_dir):
    """The index of messages after a run over all of them: what was there stays, what was missing is added, and once more nothing."""
    rows = table(spark, sf_dir, "conversations")
    indexed = rows.filter("turn % 2 = 0 and conv_id % 3 = 0").select("conv_id", "turn", F.lit("old").alias("entry"))
    build = lambda new: new.withColumn("entry", F.md5(F.concat_ws(":", "role", "text")))
    once = C.index_messages(rows, indexed, ["conv_id", "turn"], build)
    return C.index_messages(rows, once, ["conv_id", "turn"], build)


@query("SELECT conv_id, sum(length(text)) AS total_chars, max(length(text)) AS longest, sum(length(text)) // 3 AS tokens FROM conversations GROUP BY conv_id")
def message_sizes(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(n).alias("total_chars"), F.max(n).alias("longest"), F.expr("sum(length(text)) div 3").alias("tokens"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def latest_stream(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id = 3 ORDER BY turn LIMIT 50")
def first_messages(spark, sf_dir):
    return table(spark, sf_dir, "conversations").filter("conv_id = 3").orderBy("turn").limit(50).select("conv_id", "turn", "role", "text")
