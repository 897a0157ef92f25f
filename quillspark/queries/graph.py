"""Graph queries: notes written out of parts, and the links from suppliers to parts in lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import graph as G
from quillspark.queries import query, table

_NOTE = """'# N' || p_partkey || chr(10) || '[[n' || p_size || ']] and [[n' || (p_partkey % 17 + 1) || '#part|al' || p_partkey % 7 || ']] [[ al' || p_size % 9 || ' ]] ![[img' || p_partkey % 3 || '.png]] #tag' || p_partkey % 5 || ' `#no` ```#code [[n' || (p_partkey % 5 + 1) || ']]``` #x-1'"""


def _notes(spark, sf_dir):
    """A note per part with links to other parts, by name, by alias and broken, embedded images, tags and code."""
    return table(spark, sf_dir, "part").select(F.concat(F.lit("n"), "p_partkey").alias("note"), F.expr(_NOTE.replace("chr(10)", "char(10)")).alias("content"))


def _edges(spark, sf_dir):
    """Suppliers and parts that a line ties together."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")).distinct()


_EDGES = "e AS (SELECT DISTINCT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)"
_DEGREES = """i AS (SELECT dst AS note, count(*) AS n_in FROM e GROUP BY 1), o AS (SELECT src AS note, count(*) AS n_out FROM e GROUP BY 1),
 d AS (SELECT note, coalesce(n_in, 0) AS n_in, coalesce(n_out, 0) AS n_out, CASE WHEN coalesce(n_in, 0) > 5 THEN 'hub' WHEN coalesce(n_out, 0) > 10 THEN 'index'
   WHEN coalesce(n_in, 0) + coalesce(n_out, 0) < 3 THEN 'atomic' ELSE 'bridge' END AS note_type FROM i FULL JOIN o USING (note))"""


_LINKS = r"""c AS (SELECT 'n' || p_partkey AS note, NOTE AS content FROM part), l AS (SELECT DISTINCT note, trim(unnest(regexp_extract_all(content, '\[\[([^\]|#]+)(?:[#|][^\]]+)?\]\]', 1))) AS link FROM c)""".replace("NOTE", _NOTE)


@query(
    rf"""WITH {_LINKS}, b AS (SELECT note, content, regexp_replace(regexp_replace(content, '(?s)```.*?```', '', 'g'), '`[^`]+`', '', 'g') AS bare FROM c),
        t AS (SELECT DISTINCT note, unnest(regexp_extract_all(bare, '#([\p{{L}}\p{{N}}_-]+)', 1)) AS tag FROM b), e AS (SELECT DISTINCT note, unnest(regexp_extract_all(content, '!\[\[([^\]]+)\]\]', 1)) AS embed FROM b)
        SELECT note, (SELECT string_agg(link, ',' ORDER BY link) FROM l WHERE l.note = c.note) AS links, (SELECT string_agg(tag, ',' ORDER BY tag) FROM t WHERE t.note = c.note) AS tags, (SELECT string_agg(embed, ',' ORDER BY embed) FROM e WHERE e.note = c.note) AS embeds FROM c"""
)
def wikilinks(spark, sf_dir):
    t = F.col("content")
    return _notes(spark, sf_dir).select("note", F.array_join(G.wikilinks(t), ",").alias("links"), F.array_join(G.tags(t), ",").alias("tags"), F.array_join(G.embeds(t), ",").alias("embeds"))


@query(
    rf"""WITH {_LINKS}, p AS (SELECT unnest(regexp_extract_all(content, '\[\[([^\]|]+)\|([^\]]+)\]\]', 1)) AS target, unnest(regexp_extract_all(content, '\[\[([^\]|]+)\|([^\]]+)\]\]', 2)) AS alias FROM c),
        a AS (SELECT trim(alias) AS link, min(regexp_replace(trim(target), '#.*$', '')) AS target FROM p GROUP BY 1), x AS (SELECT DISTINCT note AS src, coalesce(target, link) AS dst FROM l LEFT JOIN a USING (link))
        SELECT src, dst, dst NOT IN (SELECT note FROM c) AS broken FROM x"""
)
def note_graph(spark, sf_dir):
    return G.note_edges(_notes(spark, sf_dir))


@query(
    rf"""WITH {_LINKS}, p AS (SELECT unnest(regexp_extract_all(content, '\[\[([^\]|]+)\|([^\]]+)\]\]', 1)) AS target, unnest(regexp_extract_all(content, '\[\[([^\]|]+)\|([^\]]+)\]\]', 2)) AS alias FROM c),
        a AS (SELECT trim(alias) AS link, min(regexp_replace(trim(target), '#.*$', '')) AS target FROM p GROUP BY 1), x AS (SELECT DISTINCT note AS src, coalesce(target, link) AS dst FROM l LEFT JOIN a USING (link)),
        f AS (SELECT 'img' || n_nationkey || '.png' AS note, 'v' || n_regionkey || '/img' || n_nationkey || '.png.md' AS path FROM nation)
        SELECT dst AS note, count(*) AS links, (SELECT min(path) FROM f WHERE f.note = dst) AS path FROM x WHERE dst NOT IN (SELECT note FROM c) GROUP BY dst"""
)
def missing_notes(spark, sf_dir):
    """What the notes of parts link to without it being a note, and the file that a listing has for it."""
    files = table(spark, sf_dir, "nation").select(F.concat(F.lit("v"), "n_regionkey", F.lit("/img"), "n_nationkey", F.lit(".png.md")).alias("path"))
    return G.missing_notes(G.note_edges(_notes(spark, sf_dir)), files)


@query(f"WITH {_EDGES}, {_DEGREES} SELECT * FROM d")
def degree_classes(spark, sf_dir):
    return G.degrees(_edges(spark, sf_dir))


@query(f"WITH {_EDGES}, {_DEGREES} SELECT note_type, count(*) AS n, count_if(n_in > 5) AS hubs, count_if(n_out > 10) AS indexes FROM d GROUP BY note_type")
def hub_index_tally(spark, sf_dir):
    d = G.degrees(_edges(spark, sf_dir))
    return d.groupBy("note_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("n_in") > 5).alias("hubs"), F.count_if(F.col("n_out") > 10).alias("indexes"))


@query(f"WITH {_EDGES}, {_DEGREES} SELECT note, n_in, n_out FROM d ORDER BY n_in DESC, n_out DESC, note LIMIT 20")
def hub_ranking(spark, sf_dir):
    return G.degrees(_edges(spark, sf_dir)).orderBy(F.desc("n_in"), F.desc("n_out"), "note").limit(20).select("note", "n_in", "n_out")


@query(
    f"""WITH RECURSIVE {_EDGES}, both_ AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
        r(note, depth) AS (SELECT 's1', 0 UNION SELECT b, depth + 1 FROM r JOIN both_ ON a = note WHERE depth < 2) SELECT note, min(depth) AS depth FROM r GROUP BY note"""
)
def graph_reach(spark, sf_dir):
    roots = spark.createDataFrame([("r", "s1")], "root string, note string")
    return G.layered_search(_edges(spark, sf_dir), roots, 2, 1_000_000).select("note", "depth")


@query(
    f"""WITH {_EDGES}, {_DEGREES}, n AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
        l1 AS (SELECT b AS note, 1 AS depth, 1 + row_number() OVER (ORDER BY (note_type = 'hub') DESC, (note_type = 'index') DESC, b) AS visit FROM n JOIN d ON note = b WHERE a = 's1'),
        k1 AS (SELECT * FROM l1 WHERE visit <= 15),
        c AS (SELECT b AS note, min(visit) AS pv FROM k1 JOIN n ON a = note WHERE b <> 's1' AND b NOT IN (SELECT note FROM k1) GROUP BY b),
        l2 AS (SELECT note, 2 AS depth, (SELECT coalesce(max(visit), 1) FROM k1) + row_number() OVER (ORDER BY pv, (note_type = 'hub') DESC, (note_type = 'index') DESC, note) AS visit FROM c JOIN d USING (note))
        SELECT 's1' AS note, 0 AS depth, 1 AS visit UNION ALL SELECT * FROM k1 UNION ALL SELECT * FROM l2 WHERE visit <= 15"""
)
def bfs_smart(spark, sf_dir):
    roots = spark.createDataFrame([("r", "s1")], "root string, note string")
    return G.layered_search(_edges(spark, sf_dir), roots, 2, 15).select("note", "depth", "visit")


_BFS = f"""{_EDGES}, {_DEGREES}, n AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
 l1 AS (SELECT b AS note, 1 AS depth, 1 + row_number() OVER (ORDER BY (note_type = 'hub') DESC, (note_type = 'index') DESC, b) AS visit FROM n JOIN d ON note = b WHERE a = 's1'),
 k1 AS (SELECT * FROM l1 WHERE visit <= 15), w AS (SELECT 's1' AS note, 0 AS depth, 1 AS visit UNION ALL SELECT * FROM k1)"""


@query(f"WITH {_BFS} SELECT note, visit AS visit, row_number() OVER (ORDER BY visit) AS place FROM k1 QUALIFY place <= 5")
def layer_picks(spark, sf_dir):
    roots = spark.createDataFrame([("r", "s1")], "root string, note string")
    return G.best_per_layer(G.layered_search(_edges(spark, sf_dir), roots, 1, 15)).select("note", "visit", "place")


@query(f"""WITH {_BFS} SELECT 'r' AS root, 'From r, notes: ' || (SELECT count(*) FROM w) || chr(10) || 'Level 0: s1' || chr(10) || 'Level 1: ' || (SELECT string_agg(note, ', ' ORDER BY visit) FROM k1 WHERE visit <= 11)
   || (SELECT CASE WHEN count(*) > 10 THEN ' (+' || (count(*) - 10) || ')' ELSE '' END FROM k1) AS summary""")
def walk_summary(spark, sf_dir):
    roots = spark.createDataFrame([("r", "s1")], "root string, note string")
    return G.context_summary(G.walk(_edges(spark, sf_dir), roots, "bidirectional", 1, 15))


@query(f"WITH {_EDGES} SELECT note FROM (SELECT 's' || s_suppkey AS note FROM supplier WHERE s_suppkey % 5 = 0 UNION SELECT dst FROM e JOIN supplier ON src = 's' || s_suppkey JOIN part ON dst = 'p' || p_partkey WHERE s_suppkey % 5 = 0 AND p_size > 10)")
def note_closure(spark, sf_dir):
    chosen = table(spark, sf_dir, "supplier").filter("s_suppkey % 5 = 0").select(F.concat(F.lit("s"), "s_suppkey").alias("note"))
    vault = table(spark, sf_dir, "part").filter("p_size > 10").select(F.concat(F.lit("p"), "p_partkey").alias("note"))
    return G.note_closure(chosen, _edges(spark, sf_dir), vault)


def _sizes(spark, sf_dir):
    """Numbers that point at numbers: parts at their sizes and at a remainder, so that walks have several layers and hubs."""
    part = table(spark, sf_dir, "part")
    one = part.select(F.concat(F.lit("n"), "p_partkey").alias("src"), F.concat(F.lit("n"), "p_size").alias("dst"))
    two = part.select(F.concat(F.lit("n"), "p_partkey").alias("src"), F.concat(F.lit("n"), F.col("p_partkey") % 17 + 1).alias("dst"))
    return one.unionByName(two).filter("src <> dst").distinct()


@query()
def walk_up(spark, sf_dir):
    return G.walk(_sizes(spark, sf_dir), spark.createDataFrame([("a", "n18"), ("b", "n40")], "root string, note string"), "up", 3, 8)


_SIZES = """e AS (SELECT DISTINCT src, dst FROM (SELECT 'n' || p_partkey AS src, 'n' || p_size AS dst FROM part UNION ALL SELECT 'n' || p_partkey, 'n' || (p_partkey % 17 + 1) FROM part) WHERE src <> dst)"""


def _layers_sql(name: str, roots: str, pairs: str, order: str, depth: int, nodes: int | None) -> str:
    """Common table expressions of a search in layers from `roots` (root, note) over `pairs` (a, b); its rows are in {name}{depth}."""
    out = [f"{name}k0 AS (SELECT root, note, 0 AS depth, 1 AS visit FROM ({roots}))", f"{name}0 AS (SELECT * FROM {name}k0)"]
    for d in range(1, depth + 1):
        out.append(f"{name}c{d} AS (SELECT k.root, b AS note, min(k.visit) AS pv FROM {name}k{d - 1} k JOIN ({pairs}) ON a = k.note WHERE NOT EXISTS (SELECT 1 FROM {name}{d - 1} s WHERE s.root = k.root AND s.note = b) GROUP BY ALL)")
        keep = f" WHERE visit <= {nodes}" if nodes else ""
        out.append(f"{name}k{d} AS (SELECT * FROM (SELECT c.root, note, {d} AS depth, (SELECT max(visit) FROM {name}{d - 1} s WHERE s.root = c.root) + row_number() OVER (PARTITION BY c.root ORDER BY pv, {order}) AS visit FROM {name}c{d} c JOIN d USING (note)){keep})")
        out.append(f"{name}{d} AS (SELECT * FROM {name}{d - 1} UNION ALL SELECT * FROM {name}k{d})")
    return ", ".join(out)


_DOWN_ROOTS = "SELECT * FROM (VALUES ('a', 'n18'), ('b', 'n140')) AS v(root, note)"
_BOTH = "SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e"


@query(f"""WITH {_SIZES}, {_DEGREES}, {_layers_sql("w", _DOWN_ROOTS, "SELECT src AS a, dst AS b FROM e", "10.0 / (abs(n_in + n_out - 5) + 1) DESC, note", 3, 12)} SELECT * FROM w3""")
def walk_down(spark, sf_dir):
    return G.walk(_sizes(spark, sf_dir), spark.createDataFrame([("a", "n18"), ("b", "n140")], "root string, note string"), "down", 3, 12)


_HUB_ROOTS = "SELECT * FROM (VALUES ('a', 'n140'), ('b', 'n3')) AS v(root, note)"


@query(
    f"""WITH {_SIZES}, {_DEGREES}, {_layers_sql("u", _HUB_ROOTS, "SELECT dst AS a, src AS b FROM e", "note", 3, None)},
        h AS (SELECT r.root, coalesce((SELECT arg_min(note, depth::BIGINT * 1000000000 + visit) FROM u3 JOIN d USING (note) WHERE u3.root = r.root AND n_in > 5), (SELECT note FROM d WHERE n_in > 5 ORDER BY n_in DESC, note LIMIT 1)) AS note FROM ({_HUB_ROOTS}) r),
        {_layers_sql("w", "SELECT root, note FROM h WHERE note IS NOT NULL", _BOTH, "(note_type = 'hub') DESC, (note_type = 'index') DESC, note", 1, 15)}
        SELECT root, note, 0 AS depth, 1 AS visit FROM ({_HUB_ROOTS}) UNION ALL SELECT w.root, w.note, w.depth + 1, w.visit + 1 FROM w1 w WHERE NOT EXISTS (SELECT 1 FROM ({_HUB_ROOTS}) r WHERE r.root = w.root AND r.note = w.note)"""
)
def walk_hub_first(spark, sf_dir):
    return G.hub_first_search(_sizes(spark, sf_dir), spark.createDataFrame([("a", "n140"), ("b", "n3")], "root string, note string"))


_QUESTION = """CASE p_partkey % 7 WHEN 0 THEN '¿Qué es ' || p_name || '?' WHEN 1 THEN '¿Qué aplicaciones usan ' || p_name || '?' WHEN 2 THEN 'Explica la arquitectura completa de ' || p_brand WHEN 3 THEN 'nothing to see in ' || p_type
 WHEN 4 THEN 'muestra el diagrama y las dependencias de ' || p_name WHEN 5 THEN 'detalles de la clase ' || upper(p_name) ELSE 'Todo sobre ' || p_name || ', con nombres de servicios y overview' END"""
_STANDING = "p_size % 4 = 0 AS is_hub, p_size % 4 = 1 AS is_index, CASE p_size % 4 WHEN 0 THEN 'hub' WHEN 1 THEN 'index' WHEN 2 THEN 'atomic' ELSE 'bridge' END AS note_type"


def _intent_sql() -> str:
    """The rule of query_intent. Words of the patterns begin and end with plain letters, so that borders are the same in both engines."""
    hit = lambda p: f"regexp_matches(lower(q), '(?i){p}')::int"
    up, down, both = (" + ".join(map(hit, group)) for group in (G.CONTEXT, G.DETAIL, G.EXHAUSTIVE))
    return f"""WITH x AS (SELECT p_partkey, {_QUESTION} AS q, {_STANDING} FROM part), h AS (SELECT *, {hit(G.SPECIFIC)} AS exact, {hit(G.GENERAL)} AS broad FROM x),
        s AS (SELECT *, 2 * ({up}) + (broad > exact)::int + (NOT is_hub AND note_type = 'atomic')::int AS up, 2 * ({down}) + (exact > broad)::int + is_hub::int AS down, 3 * ({both}) + (NOT is_hub AND note_type <> 'atomic' AND is_index)::int AS wide FROM h),
        d AS (SELECT *, greatest(up, down, wide) AS most, CASE WHEN greatest(up, down, wide) = 0 THEN 'bidirectional' WHEN up = greatest(up, down, wide) THEN 'up' WHEN down = greatest(up, down, wide) THEN 'down' ELSE 'bidirectional' END AS direction,
          CASE WHEN greatest(up, down, wide) = 0 THEN 0.3 ELSE least(greatest(up, down, wide) / 5.0, 1.0) END::DOUBLE AS confidence FROM s)
        SELECT p_partkey, direction, confidence, CASE WHEN direction = 'up' THEN CASE WHEN confidence > 0.7 THEN 2 ELSE 3 END WHEN direction = 'down' AND exact > broad THEN 3 ELSE 2 END AS max_depth,
        CASE WHEN direction = 'up' THEN 8 WHEN direction = 'down' THEN CASE WHEN exact > broad THEN 10 ELSE 12 END ELSE 15 END AS max_nodes, CASE direction WHEN 'up' THEN 'general' WHEN 'down' THEN 'specific' ELSE 'exhaustive' END AS priority FROM d"""


@query(_intent_sql())
def intent(spark, sf_dir):
    """Questions about parts, asked from notes of every standing."""
    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{_QUESTION} AS q", *_STANDING.replace(", p_size", "|p_size").replace(", CASE", "|CASE").split("|"))
    return rows.select("p_partkey", *[c.alias(n) for n, c in G.query_intent(F.col("q"), F.col("is_hub"), F.col("is_index"), F.col("note_type")).items()])


@query(f"WITH {_EDGES}, {_DEGREES} SELECT note, round(n_in + n_out * 0.3, 6) AS general, round(10.0 / (n_in + n_out + 1), 6) AS specific, round(10.0 / (abs(n_in + n_out - 5) + 1), 6) AS exhaustive FROM d")
def note_priority(spark, sf_dir):
    d = G.degrees(_edges(spark, sf_dir))
    return d.select("note", *[F.round(G.priority_score(p, F.col("n_in"), F.col("n_out")), 6).alias(p) for p in ("general", "specific", "exhaustive")])
