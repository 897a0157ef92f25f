"""Queries on contexts of answers, collections, conversation memory and tool catalogues."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions.text import allowed_metadata
from quillspark.operators import context as C
from quillspark.queries import query, table
from quillspark.queries.retrieval import first_vector

_ASKED = """q AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Resume el documento "' || p_name || '.docx" ya' WHEN 1 THEN 'qué dice el ARCHIVO  "el ' || p_name || '"' WHEN 2 THEN 'sobre "' || p_name || ''' y nada'
 WHEN 3 THEN 'abre ''' || p_name || '.pdf'' ahora' WHEN 4 THEN 'lee este ' || p_name WHEN 5 THEN 'el pdf de ' || p_name END AS q FROM part)"""


def _asked(spark, sf_dir):
    n, k = F.col("p_name"), F.col("p_partkey") % 6
    forms = [('Resume el documento "', '.docx" ya'), ('qué dice el ARCHIVO  "el ', '"'), ('sobre "', "' y nada"), ("abre '", ".pdf' ahora"), ("lee este ", ""), ("el pdf de ", "")]
    text = F.lit(None).cast("string")
    for i, (a, b) in enumerate(forms):
        text = F.when(k == i, F.concat(F.lit(a), n, F.lit(b))).otherwise(text)
    return table(spark, sf_dir, "part").select("p_partkey", text.alias("q"))


@query(
    f"""WITH {_ASKED} SELECT p_partkey, coalesce(regexp_replace(nullif(regexp_extract(q, '(?i)documento\\s+"([^"'']+)"', 1), ''), '(?i)^\\s*(el|este|un|una|los|las|sobre)\\s+', ''),
        regexp_replace(nullif(regexp_extract(q, '(?i)archivo\\s+"([^"'']+)"', 1), ''), '(?i)^\\s*(el|este|un|una|los|las|sobre)\\s+', ''), nullif(regexp_extract(q, '(?i)sobre\\s+"([^"'']+)"', 1), ''),
        nullif(trim(regexp_extract(q, '(?i)([^"''. ,;:]*\\.docx\\s*["''])', 1)), ''), nullif(trim(regexp_extract(q, '(?i)([^"''. ,;:]*\\.pdf\\s*["''])', 1)), '')) AS file FROM q"""
)
def file_mentions(spark, sf_dir):
    return _asked(spark, sf_dir).select("p_partkey", C.mentioned_file(F.col("q")).alias("file"))


@query(f"WITH {_ASKED} SELECT p_partkey, regexp_matches(q, '(?i)\\b(este|el)\\s+(documento|archivo|adjunto|fichero|pdf|word|excel|csv|html|ppt|docx|xlsx|txt|md|imagen|foto|video|audio)') AS pointing FROM q")
def contextual_references(spark, sf_dir):
    return _asked(spark, sf_dir).select("p_partkey", C.points_at_document(F.col("q")).alias("pointing"))


@query("SELECT 'attached' AS by, doc_id FROM documents WHERE source IN ('src3', 'src12') UNION ALL SELECT 'mentioned', doc_id FROM documents WHERE contains(lower(source), 'rc1') UNION ALL SELECT 'all', doc_id FROM documents")
def mentioned_file_filter(spark, sf_dir):
    hits = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("file"), F.col("source").alias("file_id"))
    cases = {"attached": (["src3", "src12"], "rc1"), "mentioned": (["src3"], "RC1"), "all": (["src3"], None)}
    found = [C.kept_for_files(hits, a, m).select(F.lit(n).alias("by"), "doc_id") for n, (a, m) in cases.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    """WITH n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS i FROM conversations),
       f AS (SELECT conv_id, role, min(turn) AS first, '### File: ' || role || chr(10) || chr(10) || string_agg('**Fragment ' || i || ' - turn ' || turn || '**' || chr(10) || coalesce(text, '') || chr(10) || chr(10), '' ORDER BY turn) || '---' || chr(10) || chr(10) AS part FROM n GROUP BY conv_id, role)
       SELECT conv_id, md5('## Relevant Documentation' || chr(10) || chr(10) || string_agg(part, '' ORDER BY first)) AS context_md5 FROM f GROUP BY conv_id"""
)
def context_by_file(spark, sf_dir):
    hits = table(spark, sf_dir, "conversations").select("conv_id", F.col("role").alias("file"), F.concat(F.lit("turn "), "turn").alias("section"), F.col("text").alias("content"), F.col("turn").alias("pos"))
    return C.laid_out(hits, "conv_id").select("conv_id", F.md5("context").alias("context_md5"))


def _wrapped_sql(mode: str) -> str:
    before, after = (x.replace("'", "''").replace("\n", "' || chr(10) || '") for x in C.WRAPPERS[mode].split("{}"))
    return f"'{before}' || r_name || '{after}'"


@query(f"SELECT r_name, CASE r_regionkey % 3 WHEN 0 THEN {_wrapped_sql('strict')} WHEN 1 THEN {_wrapped_sql('creative')} ELSE {_wrapped_sql('default')} END AS prompt, CASE WHEN r_regionkey > 2 THEN 0.8 ELSE 0.3 END AS confidence FROM region")
def context_wrapper(spark, sf_dir):
    mode = F.element_at(F.array(F.lit("strict"), F.lit("creative"), F.lit("other")), (F.col("r_regionkey") % 3 + 1).cast("int"))
    sources = F.when(F.col("r_regionkey") > 2, F.array("r_name")).when(F.col("r_regionkey") > 1, F.array().cast("array<string>"))
    return table(spark, sf_dir, "region").select("r_name", C.wrapped(F.col("r_name"), mode).alias("prompt"), C.confidence(sources).alias("confidence"))


@query(
    """SELECT c_custkey, CASE WHEN c_nationkey % 4 = 0 THEN 'project_' || c_nationkey WHEN c_nationkey % 4 < 3 THEN CASE WHEN c_acctbal > 5000 THEN c_mktsegment ELSE 'chat_' || c_custkey END ELSE 'documents' END AS collection FROM customer"""
)
def collection_names(spark, sf_dir):
    n = F.col("c_nationkey") % 4
    name = C.collection_name(F.when(n == 0, F.col("c_nationkey")), F.when(n < 3, F.col("c_custkey")), F.when(F.col("c_acctbal") > 5000, F.col("c_mktsegment")).otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("collection"))


@query(
    """SELECT c_custkey, 0 AS place, 'project_' || c_nationkey AS collection FROM customer WHERE c_nationkey % 3 = 0
       UNION ALL SELECT c_custkey, 1, 'chat_' || c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')"""
)
def default_collections(spark, sf_dir):
    conversations = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 3 == 0, F.col("c_nationkey")).alias("project_id"))
    files = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), (F.col("o_orderstatus") == "F").alias("processed"))
    return C.default_collections(conversations, files, "c_custkey")


@query("SELECT doc_id, md5(CASE WHEN doc_id % 3 = 0 THEN source ELSE substr(text, 1, 2000) END) AS content_md5 FROM documents")
def direct_content(spark, sf_dir):
    extracted = F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, "")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(C.direct_content(extracted, F.col("text"))).alias("content_md5"))


@query(
    """WITH q AS (SELECT label, arg_min(embedding, vec_id) AS question FROM embeddings GROUP BY label),
       s AS (SELECT label, vec_id, round(list_cosine_similarity(embedding::DOUBLE[], question::DOUBLE[]), 6) AS score FROM embeddings JOIN q USING (label)),
       r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s WHERE score >= 0.1) SELECT * FROM r WHERE rank <= 5"""
)
def memory_search(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings")
    asked = points.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("question"))
    return C.search_memory(points, asked, 5, 0.1, "label")


@query("SELECT vec_id, label, score FROM (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings WHERE label = 5) WHERE score >= 0.05 ORDER BY score DESC, vec_id LIMIT 8")
def collection_search(spark, sf_dir):
    return C.search_one_collection(table(spark, sf_dir, "embeddings"), 5, first_vector(spark, sf_dir), 8, 0.05, "label")


@query(
    """WITH l AS (SELECT p_partkey, p_size::varchar AS cap FROM part WHERE p_size > 25), g AS (SELECT p_brand, max(p_type) AS cap FROM part WHERE p_retailprice < 1100 AND p_brand < 'Brand#3' GROUP BY 1)
       SELECT p_partkey, coalesce(l.cap, g.cap, p_name) AS cap FROM part LEFT JOIN l USING (p_partkey) LEFT JOIN g USING (p_brand)"""
)
def capability_lookup(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    local = part.filter("p_size > 25").select("p_partkey", F.col("p_size").cast("string").alias("cap"))
    general = part.filter("p_retailprice < 1100 and p_brand < 'Brand#3'").select("p_brand", F.col("p_type").alias("cap"))
    return C.first_known(part, [(local, "p_partkey"), (general, "p_brand")], "cap", F.col("p_name")).select("p_partkey", "cap")


@query("SELECT p_type, p_brand, p_partkey, p_size FROM (SELECT *, row_number() OVER (PARTITION BY p_type, p_brand ORDER BY p_partkey) AS rn FROM part) WHERE rn = 1")
def template_properties(spark, sf_dir):
    return C.merged_properties(table(spark, sf_dir, "part"), "p_type", "p_brand", ["p_partkey"]).select("p_type", "p_brand", "p_partkey", "p_size")


@query(
    """WITH c AS (SELECT s_nationkey AS kind, s_name AS name FROM supplier WHERE s_acctbal > 5000) SELECT 'manual' AS mode, n_nationkey AS kind, n_name AS name, false AS configured FROM nation
       UNION ALL SELECT 'agent', n_nationkey, n_name, false FROM nation WHERE n_nationkey NOT IN (SELECT kind FROM c) UNION ALL SELECT 'agent', kind, name, true FROM c"""
)
def tool_modes(spark, sf_dir):
    physical = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("kind"), F.col("n_name").alias("name"))
    custom = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select(F.col("s_nationkey").alias("kind"), F.col("s_name").alias("name"))
    rows = [C.tools_of_mode(physical, custom, m).withColumn("mode", F.lit(m)) for m in ("manual", "agent")]
    return rows[0].unionByName(rows[1])


@query("SELECT p_partkey, CASE WHEN contains(lower(p_type), 'steel') OR contains(lower(p_type), 'tin') THEN 'embedding' WHEN contains(lower(p_type), 'brushed') THEN 'reasoning' ELSE 'chat' END AS kind FROM part")
def model_types(spark, sf_dir):
    kind = C.inferred_type(F.col("p_type"), [("embedding", ["steel", "tin"]), ("reasoning", ["brushed"])])
    return table(spark, sf_dir, "part").select("p_partkey", kind.alias("kind"))


_MODEL = "CASE p_partkey % 9 WHEN 0 THEN 'BGE-' || p_size WHEN 1 THEN 'llava:' || p_size WHEN 2 THEN 'CogVLM-' || p_name WHEN 3 THEN 'DeepSeek-R1:' || p_size WHEN 4 THEN 'Qwen3-thinking' WHEN 5 THEN 'mistral ' || p_size WHEN 6 THEN 'qwen2.5-coder' WHEN 7 THEN 'nomic-Embed-text' ELSE p_name END"


def _named(column: str, parts) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


@query(
    f"""WITH m AS (SELECT p_partkey, lower({_MODEL}) AS low FROM part), k AS (SELECT *, CASE {" ".join(f"WHEN {_named('low', parts)} THEN '{kind}'" for kind, parts in C.MODEL_NAMES)} ELSE 'chat' END AS kind FROM m)
        SELECT p_partkey, CASE WHEN kind = 'chat' AND {_named("low", C.REASONING_NAMES)} THEN 'reasoning' ELSE kind END AS model_type, kind = 'chat' AND {_named("low", C.TOOL_NAMES)} AS supports_tools,
        kind = 'chat' AND ({_named("low", C.REASONING_NAMES)} OR {_named("low", C.THINKING_NAMES)}) AS supports_thinking FROM k"""
)
def model_traits(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", *[c.alias(n) for n, c in C.model_traits(F.expr(_MODEL)).items()])


@query("SELECT p_partkey, p_type, p_brand FROM part WHERE p_brand = 'Brand#11'")
def capability_filter(spark, sf_dir):
    from quillspark.operators.relational import optional_filters

    return optional_filters(table(spark, sf_dir, "part"), {"p_brand": "Brand#11"}).select("p_partkey", "p_type", "p_brand")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'status=' || o_orderstatus ELSE 'priority=' || o_orderpriority || ',status=' || o_orderstatus END AS params FROM orders")
def known_params(spark, sf_dir):
    values = F.create_map(F.lit("priority"), "o_orderpriority", F.lit("clerk"), F.col("o_custkey").cast("string"), F.lit("status"), "o_orderstatus")
    allowed = F.when(F.col("o_orderkey") % 2 == 0, F.array(F.lit("status"))).otherwise(F.array(F.lit("status"), F.lit("priority")))
    entries = F.transform(F.map_entries(allowed_metadata(values, allowed)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.array_sort(entries), ",").alias("params"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 4 = 1 THEN n_name || ' (Imported)' ELSE n_name END AS name FROM nation")
def template_import(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    return C.imported(C.exported(nation, ["n_nationkey", "name"]), "n_nationkey long, name string", nation.filter("n_nationkey % 4 = 1"))
