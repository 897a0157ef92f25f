"""Relational queries over the business tables: filters, pages, joins, aggregates, set operations and SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import relational as R
from quillspark.operators import sync as S
from quillspark.plans.registry import run_sql
from quillspark.queries import query, table


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey IN (1, 2, 3, 4, 5) ORDER BY c_acctbal DESC, c_custkey LIMIT 20 OFFSET 5")
def list_filter_page(spark, sf_dir):
    rows = R.optional_filters(table(spark, sf_dir, "customer"), {"c_mktsegment": "BUILDING", "c_name": None}, {"c_nationkey": [1, 2, 3, 4, 5]})
    return R.page(rows, [F.desc("c_acctbal"), "c_custkey"], 5, 20).select("c_custkey", "c_name", "c_acctbal")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RE_%' OR p_type ILIKE '%RE_%' OR p_brand ILIKE '%RE_%'")
def ilike_or_search(spark, sf_dir):
    return R.optional_filters(table(spark, sf_dir, "part"), search="RE_", search_in=["p_name", "p_type", "p_brand"]).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 7, 23)")
def in_list(spark, sf_dir):
    return R.optional_filters(table(spark, sf_dir, "part"), within={"p_size": [1, 7, 23]}).select("p_partkey", "p_size")


@query("SELECT DISTINCT c_mktsegment AS category FROM customer WHERE c_mktsegment IS NOT NULL AND c_mktsegment <> ''")
def distinct_categories(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter("c_mktsegment is not null and c_mktsegment <> ''").select(F.col("c_mktsegment").alias("category")).distinct()


@query("SELECT count(*) AS total, count(*) FILTER (c_acctbal > 0) AS active, count(DISTINCT c_nationkey) AS nations FROM customer")
def filtered_count(spark, sf_dir):
    return table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("c_acctbal") > 0).alias("active"), F.countDistinct("c_nationkey").alias("nations"))


@query("SELECT c_custkey, coalesce(n, 0) AS n_children, last_stamp FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS last_stamp FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def list_with_counts(spark, sf_dir):
    children = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return R.list_with_counts(table(spark, sf_dir, "customer"), children, "c_custkey", "o_orderdate").select("c_custkey", "n_children", "last_stamp")


@query("SELECT event_id, (props->>'$.k') AS k, CAST(props->>'$.k' AS BIGINT) * 2 AS doubled FROM events")
def json_extract(spark, sf_dir):
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), (k.cast("long") * 2).alias("doubled"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'new' ELSE props->>'$.k' END AS k, event_type AS kind FROM events""")
def json_merge(spark, sf_dir):
    new = F.to_json(F.struct(F.when(F.col("event_id") % 2 == 0, "new").alias("k"), F.col("event_type").alias("kind")))
    merged = R.merge_json(F.col("props"), new)
    return table(spark, sf_dir, "events").select("event_id", merged["k"].alias("k"), merged["kind"].alias("kind"))


@query(
    """SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source, sha256(text) ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1"""
)
def dedup_by_hash(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("hash"))
    return R.first_of_each(rows, ["source", "hash"], ["doc_id"]).select("doc_id", "source")


@query("SELECT s_suppkey, s_name FROM supplier WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey = s_nationkey AND n_regionkey = 1)")
def registry_semi(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return table(spark, sf_dir, "supplier").join(nation, "s_nationkey", "left_semi").select("s_suppkey", "s_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 100000)")
def deleted_files(spark, sf_dir):
    return R.delete_by(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").filter("o_orderpriority = '1-URGENT' and o_totalprice > 100000").withColumnRenamed("o_custkey", "c_custkey"), "c_custkey").select("c_custkey")


@query("SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'new' ELSE p_name END AS p_name FROM part UNION ALL SELECT 1000000000 + p_partkey, 'new' FROM part WHERE p_partkey % 500 = 0")
def upsert_rows(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    changed = part.filter("p_partkey % 10 = 0").select("p_partkey", F.lit("new").alias("p_name"))
    added = part.filter("p_partkey % 500 = 0").select((F.col("p_partkey") + 1000000000).alias("p_partkey"), F.lit("new").alias("p_name"))
    return R.upsert(part, changed.unionByName(added), "p_partkey")


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey <> 3 AND s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R' AND l_linenumber = 7)")
def delete_cascade(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").filter("s_nationkey <> 3")
    gone = table(spark, sf_dir, "lineitem").filter("l_quantity = 50 and l_returnflag = 'R' and l_linenumber = 7").select(F.col("l_suppkey").alias("s_suppkey"))
    return R.delete_by(rows, gone, "s_suppkey").select("s_suppkey")


@query("SELECT r_name, string_agg(n_name, ', ' ORDER BY n_name) AS nations, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name")
def grouped_lists(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ", ").alias("nations"), F.count(F.lit(1)).alias("n"))


@query(
    """SELECT c_mktsegment, string_agg(c_name, ', ' ORDER BY c_custkey) AS first_names FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS rn FROM customer) WHERE rn <= 3 GROUP BY 1"""
)
def first_n_per_category(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "customer").withColumn("rn", F.row_number().over(W.partitionBy("c_mktsegment").orderBy("c_custkey"))).filter("rn <= 3")
    names = F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name"))), lambda x: x["c_name"])
    return rows.groupBy("c_mktsegment").agg(F.array_join(names, ", ").alias("first_names"))


_OLD = "SELECT p_brand AS provider, p_partkey AS model_name, CASE p_size % 3 WHEN 0 THEN 'reasoning' WHEN 1 THEN 'chat' ELSE 'embedding' END AS model_type, p_size % 5 = 0 AS is_custom FROM part WHERE p_partkey % 4 <> 0"
_NEW = "SELECT p_brand AS provider, p_partkey AS model_name, CASE p_size % 2 WHEN 0 THEN 'reasoning' ELSE 'chat' END AS model_type FROM part WHERE p_partkey % 7 <> 0"


@query(
    f"""WITH o AS (SELECT provider, model_name, model_type AS old, is_custom FROM ({_OLD})), n AS (SELECT provider, model_name, model_type AS new FROM ({_NEW}))
       SELECT provider, model_name, CASE WHEN old IS NULL THEN new WHEN NOT is_custom AND old = 'chat' AND new = 'reasoning' THEN 'reasoning' ELSE old END AS model_type,
       coalesce(is_custom, false) AS is_custom, CASE WHEN old IS NULL THEN 'insert' WHEN NOT is_custom AND old = 'chat' AND new = 'reasoning' THEN 'update' ELSE 'keep' END AS action
       FROM o FULL JOIN n USING (provider, model_name)"""
)
def catalog_sync(spark, sf_dir):
    """A catalogue and a new listing of it, both written out of parts: each lacks some of the other's."""
    part = table(spark, sf_dir, "part")
    kind, new = "case p_size % 3 when 0 then 'reasoning' when 1 then 'chat' else 'embedding' end as model_type", "case p_size % 2 when 0 then 'reasoning' else 'chat' end as model_type"
    old = part.filter("p_partkey % 4 <> 0").selectExpr("p_brand as provider", "p_partkey as model_name", kind, "p_size % 5 = 0 as is_custom")
    return S.sync_catalog(old, part.filter("p_partkey % 7 <> 0").selectExpr("p_brand as provider", "p_partkey as model_name", new))


@query(
    """WITH o AS (SELECT 'tool' || n_nationkey AS tool_type, n_name AS name, 'old' AS description, n_nationkey % 3 > 0 AS is_active FROM nation WHERE n_nationkey % 4 > 0), f AS (SELECT 'tool' || s_nationkey AS tool_type, max(s_name) AS name, 'new' AS description FROM supplier WHERE s_nationkey % 5 > 0 GROUP BY s_nationkey)
       SELECT tool_type, CASE WHEN f.name IS NULL THEN o.name ELSE f.name END AS name, CASE WHEN f.name IS NULL THEN o.description ELSE f.description END AS description, coalesce(is_active, true) AS is_active,
       CASE WHEN o.name IS NULL THEN 'insert' WHEN f.name IS NOT NULL THEN 'update' ELSE 'keep' END AS action FROM o FULL JOIN f USING (tool_type)"""
)
def template_sync(spark, sf_dir):
    """Templates of tools, some found again (one per supplier of a nation), some new, some no longer found."""
    old = table(spark, sf_dir, "nation").filter("n_nationkey % 4 > 0").select(F.concat(F.lit("tool"), "n_nationkey").alias("tool_type"), F.col("n_name").alias("name"), F.lit("old").alias("description"), (F.col("n_nationkey") % 3 > 0).alias("is_active"))
    found = table(spark, sf_dir, "supplier").filter("s_nationkey % 5 > 0").select(F.concat(F.lit("tool"), "s_nationkey").alias("tool_type"), F.col("s_name").alias("name"), F.lit("new").alias("description"))
    return S.sync_templates(old, found)


@query("SELECT count(*) AS models, count_if(p_size > 40) AS large, count_if(p_retailprice > 1000) AS costly, count_if(p_type LIKE '%STEEL%') AS steel, count_if(p_brand = 'Brand#11') AS brand_11, count_if(p_size <= 5) AS small FROM part")
def catalog_summary(spark, sf_dir):
    tests = {"large": "p_size > 40", "costly": "p_retailprice > 1000", "steel": "p_type like '%STEEL%'", "brand_11": "p_brand = 'Brand#11'", "small": "p_size <= 5"}
    return R.tallies(table(spark, sf_dir, "part"), {n: F.expr(t) for n, t in tests.items()}, "models")


_COPIES = "CASE WHEN p_size = 1 THEN p_brand || ' (Copy)' WHEN p_size % 2 = 0 THEN p_brand || ' (Copy ' || p_size || ')' ELSE p_brand END"


@query(
    f"""WITH t AS (SELECT DISTINCT {_COPIES} AS name FROM part), w AS (SELECT n, 'Brand#11' || CASE n WHEN 1 THEN ' (Copy)' ELSE ' (Copy ' || n || ')' END AS name FROM range(1, 1000) AS r(n))
        SELECT name FROM w WHERE name NOT IN (SELECT name FROM t) ORDER BY n LIMIT 1"""
)
def copy_name(spark, sf_dir):
    """The next free name of a copy, where parts have taken some names."""
    return R.copy_name("Brand#11", table(spark, sf_dir, "part").select(F.expr(_COPIES).alias("name")), "name")


_TOOL = """SELECT n_name, sum(l_extendedprice * (1 - l_discount)) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey WHERE o_orderdate >= {0} AND l_returnflag = {1} GROUP BY n_name"""


@query(f"SELECT n_name, round(revenue, 2) AS revenue FROM ({_TOOL.format(chr(39) + '1995-01-01' + chr(39) + '::timestamp', chr(39) + 'R' + chr(39))}) ORDER BY revenue DESC, n_name LIMIT 10")
def sql_tool(spark, sf_dir):
    views = {t: table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "nation")}
    sql = f"SELECT n_name, round(revenue, 2) AS revenue FROM ({_TOOL.format('cast(:since as timestamp)', ':flag')}) ORDER BY revenue DESC, n_name"
    return run_sql(spark, sql, {"since": "1995-01-01", "flag": "R"}, views, fetch_size=10)


@query(
    """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
       FROM lineitem WHERE l_shipdate <= '1998-09-02'::timestamp GROUP BY ALL"""
)
def pricing_summary(spark, sf_dir):
    return run_sql(
        spark,
        """SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
           FROM lineitem WHERE l_shipdate <= cast(:day as timestamp) GROUP BY l_returnflag, l_linestatus""",
        {"day": "1998-09-02"},
        {"lineitem": table(spark, sf_dir, "lineitem")},
        fetch_size=0,
    )
