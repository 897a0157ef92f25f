"""Queries on folders of notes and their metadata; the notes are written out of rows of the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.functions import metadata as M
from quillspark.operators import graph as G
from quillspark.operators import notes as O
from quillspark.operators.stages import shared_folder, short_batches
from quillspark.queries import query, table
from quillspark.queries.graph import _BFS, _edges
from quillspark.sources import formats as X


def _dealt(spark, sf_dir):
    """Parts dealt over all cores by their key: many rows may lie in one group of a file, which one task reads."""
    return table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_size").repartition("p_partkey")


def _front(part):
    """A note per part with nested front matter, lists and a text with tags."""
    lines = [
        F.lit("---"), F.concat(F.lit('title: "'), "p_name", F.lit('"')), F.concat(F.lit("size: "), "p_size", F.lit("  # pieces")), F.lit("tags:"), F.concat(F.lit("  - '"), "p_brand", F.lit("'")), F.concat(F.lit("  - "), "p_type"), F.lit("owner:"),
        F.concat(F.lit("  name: N"), F.col("p_partkey") % 7), F.lit("  deep:"), F.concat(F.lit("    k: "), "p_partkey"), F.lit("parts:"), F.concat(F.lit("- a: "), "p_size"), F.lit("  b: x"), F.concat(F.lit("status: [on, s"), F.col("p_size") % 3, F.lit("]")), F.lit("empty:"), F.lit("---"),
        F.concat(F.lit("intro #t"), F.col("p_partkey") % 5), F.concat(F.lit("# The "), "p_name", F.lit(" #x")), F.concat(F.lit("body `#c` "), "p_brand"),
    ]
    return part.select("p_partkey", "p_name", "p_brand", "p_type", "p_size", F.array_join(F.array(*lines), "\n").alias("note"))


def _entries(m):
    return F.array_join(F.array_sort(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|")


@query(
    """SELECT p_partkey, array_to_string(list_sort(['title=' || p_name, 'size=' || p_size, 'tags[0]=' || p_brand, 'tags[1]=' || p_type, 'owner.name=N' || p_partkey % 7, 'owner.deep.k=' || p_partkey, 'parts[0].a=' || p_size, 'parts[0].b=x',
       'status[0]=on', 'status[1]=s' || p_size % 3]), '|') AS paths, 'doc_size=' || p_size || '|doc_title=' || p_name AS section_fields, 'fm_size=' || p_size || '|fm_title=' || p_name AS document_fields FROM part"""
)
def front_matter(spark, sf_dir):
    short_batches(spark)
    rows = _front(_dealt(spark, sf_dir)).withColumn("m", M.front_matter_paths(F.col("note")))
    return rows.select("p_partkey", _entries(F.col("m")).alias("paths"), _entries(M.promoted(F.col("m"), "doc_")).alias("section_fields"), _entries(M.promoted(F.col("m"), "fm_")).alias("document_fields"))


@query("SELECT p_partkey, 'The ' || p_name AS title, 't' || p_partkey % 5 || ',x,c' || coalesce(nullif(',' || array_to_string(regexp_extract_all(p_brand, '#([A-Za-z0-9_-]+)', 1), ','), ','), '') AS tags FROM part")
def note_titles(spark, sf_dir):
    return _front(table(spark, sf_dir, "part")).select("p_partkey", M.document_title(F.col("note")).alias("title"), F.array_join(F.filter(M.inline_tags(F.regexp_replace("note", r"(?s)\A---.*?\n---\n", "")), lambda t: t != ""), ",").alias("tags"))


@query("SELECT p_partkey, md5('**Title**: ' || p_name || chr(10) || chr(10) || '# One' || chr(10) || p_brand || chr(10) || chr(10) || '### Two' || chr(10) || p_type) AS content_md5 FROM part")
def note_content(spark, sf_dir):
    short_batches(spark)
    rows = _front(_dealt(spark, sf_dir))
    section = lambda title, text, level: F.struct(F.lit(title).alias("title"), F.col(text).alias("content"), F.lit(level).alias("level"))
    return rows.select("p_partkey", F.md5(M.full_content(M.front_matter_paths(F.col("note")), F.array(section("One", "p_brand", 0), section("Two", "p_type", 3)))).alias("content_md5"))


@query(
    """SELECT doc_id, substr(text, 1, 500) AS text, least(5, 1 + doc_id % 9)::int AS n_list, least(10, 1 + doc_id % 14)::int AS n_entries, substr(source || ' ' || text, 1, 500) AS inner_text, least(5, 1 + doc_id % 9)::int AS n_inner
       FROM documents WHERE text IS NOT NULL"""
)
def metadata_truncation(spark, sf_dir):
    """Metadata with a text, a list, an object and both again one level deeper, cut at every level."""
    docs = table(spark, sf_dir, "documents").filter("text is not null")
    numbers = F.sequence(F.lit(0), (F.col("doc_id") % 9).cast("int"))
    entries = F.map_from_entries(F.transform(F.sequence(F.lit(0), (F.col("doc_id") % 14).cast("int")), lambda k: F.struct(F.concat(F.lit("k"), k), k)))
    value = F.to_json(F.struct("text", numbers.alias("list"), entries.alias("entries"), F.struct(F.concat_ws(" ", "source", "text").alias("text"), F.transform(numbers, lambda n: F.struct(n.alias("n"))).alias("list")).alias("inner")))
    cut = docs.select("doc_id", M.truncated_json(value).alias("j"))
    at = lambda path: F.get_json_object("j", path)
    return cut.select("doc_id", at("$.text").alias("text"), F.json_array_length(at("$.list")).alias("n_list"), F.size(F.json_object_keys(at("$.entries"))).alias("n_entries"), at("$.inner.text").alias("inner_text"), F.json_array_length(at("$.inner.list")).alias("n_inner"))


@query(
    """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'city=' || p_name || '|q=' || p_name WHEN 1 THEN 'city=' || p_brand || '|q=' || p_brand WHEN 2 THEN 'city=a|q=' || p_name ELSE 'deep=' || p_name || '|z=' || p_name END AS params FROM part"""
)
def alias_mapping(spark, sf_dir):
    """A key and its only tag name the same parameter; what is given stays as it is."""
    config = F.lit('{"q": "{{ city }}", "url": "/{{a}}/{{b}}", "in": {"list": [{"z": "{{deep}}"}]}}')
    k = F.col("p_partkey") % 4
    given = F.when(k == 0, F.create_map(F.lit("q"), "p_name")).when(k == 1, F.create_map(F.lit("city"), "p_brand")).when(k == 2, F.create_map(F.lit("q"), "p_name", F.lit("city"), F.lit("a"))).otherwise(F.create_map(F.lit("z"), "p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", _entries(M.with_aliases(config, given)).alias("params"))


def _paths(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    note = F.concat(F.lit("/r/v"), k % 5, F.repeat(F.lit("/d"), (k % 8).cast("int")), F.when(k % 11 == 0, "/.trash").otherwise(""), F.lit("/n"), k, F.lit(".md"))
    marker = F.when(k % 50 == 1, F.concat(F.lit("/r/v1/.obsidian/a"), k, F.lit(".json"))).when(k % 50 == 2, F.lit("/r/v3/d/d/.obsidian/x"))
    folder = F.concat(F.lit("/r/v"), k % 6, F.repeat(F.lit("/d"), (k % 3).cast("int")))
    return part.select(F.explode(F.array_compact(F.array(note, marker))).alias("path")), part.select(F.explode(F.array(note, folder)).alias("path"))


@query(
    """WITH f AS (SELECT DISTINCT '/r/v' || p_partkey % 5 || repeat('/d', (p_partkey % 8)::int) || CASE WHEN p_partkey % 11 = 0 THEN '/.trash' ELSE '' END || '/n' || p_partkey || '.md' AS file FROM part),
       r AS (SELECT '/r/v1' AS root WHERE (SELECT count(*) FROM part WHERE p_partkey % 50 = 1) > 0 UNION ALL SELECT '/r/v3/d/d' WHERE (SELECT count(*) FROM part WHERE p_partkey % 50 = 2) > 0),
       a AS (SELECT file AS path FROM f UNION SELECT '/r/v' || p_partkey % 6 || repeat('/d', (p_partkey % 3)::int) FROM part),
       n AS (SELECT a.path, count(*) AS n_all, count_if(NOT regexp_matches(substr(file, length(a.path) + 1), '/[.]')) AS n_seen FROM a JOIN f ON starts_with(file, a.path || '/') GROUP BY 1),
       o AS (SELECT a.path, n_all, n_seen, a.path IN (SELECT root FROM r) AS is_root, a.path IN (SELECT file FROM f) AS is_note, string_split(a.path, '/') AS x FROM a LEFT JOIN n USING (path)),
       u AS (SELECT path, l, array_to_string(x[1 : len(x) - l - is_note::int], '/') AS root FROM o, unnest(range(0, 5)) AS t(l) WHERE is_note OR n_all > 0),
       v AS (SELECT path, arg_min(root, l) AS near FROM u JOIN r USING (root) GROUP BY 1)
       SELECT path, CASE WHEN is_root THEN 'vault' WHEN is_note THEN 'single_file' WHEN n_all > 0 THEN 'subset' ELSE 'single_file' END AS type, CASE WHEN is_root THEN path ELSE near END AS vault_root, (is_root OR near IS NOT NULL) AS is_vault,
       coalesce(CASE WHEN is_root THEN n_seen WHEN is_note THEN 1 ELSE n_all END, 0) AS n_notes FROM o LEFT JOIN v USING (path)"""
)
def vault_detection(spark, sf_dir):
    """Notes in nested folders of which two hold a marker, asked for one by one and by folder."""
    paths, asked = _paths(spark, sf_dir)
    return O.detect(asked, paths)


def _cells(spark, sf_dir):
    """Orders of a customer as the rows of a table: some name authors, some have rows of preparation, some neither."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("path"), "o_orderkey", "o_orderstatus", "o_orderpriority")
    text = F.when(F.col("o_orderkey") % 3 == 0, "  ").otherwise(F.concat(F.lit(" "), "o_orderpriority", F.lit("  by "), F.col("o_orderkey") % 4))
    first = F.when(F.col("o_orderstatus") == "P", "Preparación").otherwise(F.col("o_orderstatus"))
    row = F.array(F.struct(F.lit(0).alias("col"), first.alias("text")), F.struct(F.lit(1).alias("col"), F.concat(F.lit("P"), F.col("o_orderkey") % 5).alias("text")), F.struct(F.lit(2).alias("col"), text.alias("text")))
    body = orders.select("path", F.lit(0).alias("table"), F.col("o_orderkey").alias("row"), F.explode(row).alias("c")).select("path", "table", "row", "c.col", "c.text")
    heads = F.when(F.col("path") % 3 == 0, F.array(*map(F.lit, ("Versión", "Fecha", "  AUTOR ", "Resumen")))).otherwise(F.array(*map(F.lit, ("", "nombre", "fecha"))))
    head = orders.select("path").distinct().select("path", F.lit(0).alias("table"), F.lit(0).cast("long").alias("row"), F.posexplode(heads).alias("col", "text"))
    return body.unionByName(head)


@query(
    """WITH c AS (SELECT o_custkey AS path, 0 AS kind, o_orderkey AS row, o_orderpriority || ' by ' || o_orderkey % 4 AS text FROM orders WHERE o_custkey % 3 = 0 AND o_orderkey % 3 <> 0
         UNION ALL SELECT o_custkey, 1, o_orderkey, 'P' || o_orderkey % 5 FROM orders WHERE o_orderstatus = 'P'),
       f AS (SELECT path, text, min(kind * 1000000000 + row) AS place FROM c WHERE row > 0 GROUP BY ALL)
       SELECT p.path, (SELECT arg_min(text, place) FROM f WHERE f.path = p.path) AS author, coalesce((SELECT list(text ORDER BY place) FROM f WHERE f.path = p.path), []) AS authors, p.path % 3 = 0 AS has_history FROM (SELECT DISTINCT o_custkey AS path FROM orders) p"""
)
def table_authors(spark, sf_dir):
    return O.table_authors(_cells(spark, sf_dir).filter("row > 0 or table = 0"))


@query(
    f"""WITH {_BFS}, p AS (SELECT note, visit, row_number() OVER (ORDER BY visit) AS place FROM k1 QUALIFY place <= 5),
        a AS (SELECT p.note, embedding::DOUBLE[] AS y FROM p JOIN embeddings ON vec_id = substr(note, 2)::BIGINT % 400),
        s AS (SELECT note, doc_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], y), 6) AS score, substr(text, 1, 350) AS content FROM a, documents JOIN embeddings ON doc_id = vec_id),
        b AS (SELECT *, row_number() OVER (PARTITION BY note ORDER BY score DESC, id) AS r FROM s WHERE score >= 0.25)
        SELECT 'r' AS root, string_agg('**↔ [Nivel 1] ' || note || '**' || chr(10) || coalesce(content, '') || chr(10), chr(10) || '---' || chr(10) || chr(10) ORDER BY place) AS context FROM b JOIN p USING (note) WHERE r = 1"""
)
def related_notes(spark, sf_dir):
    """The best chunk of each picked note; the vector of a note's question is that of its number."""
    roots = spark.createDataFrame([("r", "s1")], "root string, note string")
    picks = G.best_per_layer(G.layered_search(_edges(spark, sf_dir), roots, 1, 15))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = picks.withColumn("vec_id", F.substring("note", 2, 20).cast("long") % 400).join(vectors, "vec_id").select("note", "embedding").collect()  # at most eight picks of the one root
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("content")).join(vectors.withColumnRenamed("vec_id", "id"), "id")
    found = O.related_texts(picks, [(r["note"], r["embedding"]) for r in asked], chunks)
    return O.expanded_context(found, F.lit("bidirectional"))


@query(
    """WITH r AS (SELECT n_regionkey AS file, row_number() OVER (PARTITION BY n_regionkey ORDER BY c_custkey) - 1 AS n, concat_ws(' | ', c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_mktsegment || ', x' END) AS line FROM customer JOIN nation ON c_nationkey = n_nationkey),
       f AS (SELECT file, count(*) AS row_count FROM r GROUP BY 1)
       SELECT file, CASE file % 3 WHEN 0 THEN ',' WHEN 1 THEN ';' ELSE chr(9) END AS delimiter, row_count, (n // 100)::int AS place, CASE WHEN row_count <= 100 THEN 'CSV Data (1-' || row_count || ' rows)' ELSE 'CSV Data (rows ' || (min(n) + 1) || '-' || (max(n) + 1) || ')' END AS title,
       md5('key | name | segment' || chr(10) || repeat('-', 23) || chr(10) || string_agg(line, chr(10) ORDER BY n)) AS content_md5 FROM r JOIN f USING (file) GROUP BY file, row_count, n // 100"""
)
def csv_source(spark, sf_dir):
    """Customers of each region in a CSV file of its own dialect, written and read again."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    segment = F.when(F.col("c_custkey") % 5 == 0, F.lit(None)).otherwise(F.concat("c_mktsegment", F.lit(", x")))
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nation), "c_nationkey").select("n_regionkey", F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), segment.alias("segment"))
    root = f"{shared_folder(spark)}/csv-{uuid.uuid4().hex}"
    for region in range(5):
        sep = ",;\t"[region % 3]
        rows.filter(F.col("n_regionkey") == region).drop("n_regionkey").coalesce(1).sortWithinPartitions("key").write.option("header", True).option("sep", sep).option("quoteAll", True).option("emptyValue", "").csv(f"{root}/f{region}")
    files, parts = X.read_csv(spark, root)
    out = parts.join(files.select("path", "delimiter", "row_count"), "path")
    return out.select(F.regexp_extract("path", r"/f(\d)/", 1).cast("int").alias("file"), "delimiter", "row_count", "place", "title", F.md5("content").alias("content_md5"))
