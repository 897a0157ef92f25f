"""The note graph: links, aliases, tags, degrees, classes, query intent and bounded layered search."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators.stages import materialised

LINK = r"\[\[([^\]|#]+)(?:[#|][^\]]+)?\]\]"


def wikilinks(text: Column) -> Column:
    """Distinct link targets, sorted."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(LINK), F.lit(1)), lambda x: F.trim(x))))


def aliases(text: Column) -> Column:
    """alias -> target of [[target|alias]]; the target keeps its #section, the last of equal aliases wins."""
    pattern = F.lit(r"\[\[([^\]|]+)\|([^\]]+)\]\]")
    pairs = F.arrays_zip(F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), lambda x: F.trim(x)).alias("key"), F.transform(F.regexp_extract_all(text, pattern, F.lit(1)), lambda x: F.trim(x)).alias("value"))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def tags(text: Column) -> Column:
    """#tags outside code blocks and code spans."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?s)```.*?```", ""), r"`[^`]+`", "")
    return F.array_sort(F.array_distinct(F.regexp_extract_all(bare, F.lit(r"(?U)#([\w-]+)"), F.lit(1))))


def embeds(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"!\[\[([^\]]+)\]\]"), F.lit(1))))


def note_edges(notes: DataFrame, note: str = "note", text: str = "content") -> DataFrame:
    """src, dst, broken: one edge per link, aliases of all notes resolved."""
    links = notes.select(F.col(note).alias("src"), F.explode(wikilinks(F.col(text))).alias("link"))
    names = notes.select(F.explode(aliases(F.col(text))).alias("link", "target")).groupBy("link").agg(F.min(F.regexp_replace("target", "#.*$", "")).alias("target"))
    known = notes.select(F.col(note).alias("dst")).distinct().withColumn("_known", F.lit(True))
    out = links.join(names, "link", "left").select("src", F.coalesce("target", "link").alias("dst")).distinct()
    return out.join(known, "dst", "left").select("src", "dst", F.col("_known").isNull().alias("broken"))


def missing_notes(edges: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """note, links, path: notes that are linked to but were not scanned (note_edges), how often, and their first file in the vault.

    files lists the vault's notes by path; a note without a file has a null path.
    """
    wanted = edges.filter("broken").groupBy(F.col("dst").alias("note")).agg(F.count(F.lit(1)).alias("links"))
    named = files.filter(F.col(path).endswith(".md")).select(F.regexp_extract(path, r"([^/]+)\.md$", 1).alias("note"), F.col(path).alias("path"))
    return wanted.join(named.groupBy("note").agg(F.min("path").alias("path")), "note", "left")


def degrees(edges: DataFrame) -> DataFrame:
    """note, n_in, n_out and note_type: hub over 5 in, index over 10 out, atomic under 3 links, else bridge."""
    out = edges.groupBy(F.col("src").alias("note")).agg(F.count(F.lit(1)).alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("note")).agg(F.count(F.lit(1)).alias("n_in"))
    return _classed(out.join(into, "note", "full"))


def _classed(both: DataFrame) -> DataFrame:
    both = both.select("note", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))
    kind = F.when(F.col("n_in") > 5, "hub").when(F.col("n_out") > 10, "index").when(F.col("n_in") + F.col("n_out") < 3, "atomic").otherwise("bridge")
    return both.withColumn("note_type", kind)


def priority_score(priority: str, n_in: Column, n_out: Column) -> Column:
    """general: hubs; specific: few links; exhaustive: about five links. An unknown priority counts as exhaustive."""
    if priority == "general":
        return n_in + n_out * 0.3
    if priority == "specific":
        return 10.0 / (n_in + n_out + 1)
    return 10.0 / (F.abs(n_in + n_out - 5) + 1)


def _small(rows: DataFrame, most: int = 200_000) -> DataFrame:
    """rows (materialised) as the broadcast side of a join if they are few."""
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def _neighbours(edges: DataFrame, layer: DataFrame, seen: DataFrame, direction: str) -> DataFrame:
    """root, note, parent: what the edges of a layer's notes lead to and the root has not seen; the parent visited first claims it.

    Only edges of the layer are looked at: a layer of few notes is broadcast to a scan of the edges.
    """
    front = layer.select("root", F.col("note").alias("a"), F.col("visit").alias("parent"))
    ends = {"down": [("src", "dst")], "up": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
    front, found = _small(front), None
    for near, far in ends:
        part = edges.select(F.col(near).alias("a"), F.col(far).alias("note")).filter("a <> note").join(front, "a").select("root", "note", "parent")
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("root", "note").agg(F.min("parent").alias("parent"))
    return found.join(_small(seen.select("root", "note")), ["root", "note"], "left_anti")


def _standing(edges: DataFrame, found: DataFrame) -> DataFrame:
    """degrees of the notes of found; of few notes their own edges are counted, and no others."""
    names = materialised(found.select("note").distinct())
    few = _small(names)
    own = [edges.join(few.withColumnRenamed("note", end), end, "left_semi") for end in ("src", "dst")]
    out = own[0].groupBy(F.col("src").alias("note")).agg(F.count(F.lit(1)).alias("n_out"))
    into = own[1].groupBy(F.col("dst").alias("note")).agg(F.count(F.lit(1)).alias("n_in"))
    return _classed(out.join(into, "note", "full"))


def layered_search(edges: DataFrame, roots: DataFrame, max_depth: int = 2, max_nodes: int = 15, direction: str = "both", order: Sequence[Column] | None = None) -> DataFrame:
    """root, note, depth, visit: breadth-first search from each root, a few joins per layer.

    roots: root, note. Inside a layer the parents go in order of their visit and each one's neighbours in `order`
    (columns of degrees and note; by default hubs, then indexes, then names); the first parent claims a note. Each root
    stops at max_nodes notes, itself included. A layer is computed once, from the edges of the layer before; the degrees
    of its notes are counted, and no others; nothing is collected.
    """
    edges = materialised(edges.select("src", "dst"))
    order = order or [F.desc(F.col("note_type") == "hub"), F.desc(F.col("note_type") == "index"), F.col("note")]
    seen = layer = materialised(roots.select("root", "note", F.lit(0).alias("depth"), F.lit(1).alias("visit")))
    for depth in range(1, max_depth + 1):
        found = materialised(_neighbours(edges, layer, seen, direction))
        ranked = found.join(_standing(edges, found), "note")
        count = seen.groupBy("root").agg(F.max("visit").alias("_base"))
        place = F.row_number().over(W.partitionBy("root").orderBy("parent", *order))
        ranked = ranked.withColumn("_place", place).filter(F.col("_place") <= max_nodes).join(count, "root").withColumn("visit", F.col("_base") + F.col("_place")).filter(F.col("visit") <= max_nodes)
        layer = materialised(ranked.select("root", "note", F.lit(depth).alias("depth"), F.col("visit").cast("int").alias("visit")))
        seen = seen.unionByName(layer)
    return seen


def upward_search(edges: DataFrame, roots: DataFrame, max_depth: int = 3, max_nodes: int = 8) -> DataFrame:
    """root, note, depth, visit: from each root towards the notes that point at it, those most pointed at first.

    A parent that meets one of the three biggest hubs, not yet visited, takes this one alone. Parents go in order of
    their visit and the first claims a note; a root has at most max_nodes of them, so its hubs are dealt out in one array.
    """
    edges = materialised(edges.select("src", "dst"))
    info = materialised(degrees(edges))
    big = info.filter("note_type = 'hub'").orderBy(F.desc("n_in"), "note").limit(3).select("note", F.lit(True).alias("big"))
    near = edges.filter("src <> dst").select(F.col("dst").alias("a"), F.col("src").alias("note")).distinct()
    near = materialised(near.join(info.select("note", "n_in"), "note").join(F.broadcast(big), "note", "left"))  # three rows
    none = F.array().cast("array<struct<parent:int,note:string>>")

    def deal(taken: Column, one: Column) -> Column:
        free = F.filter(one["hubs"], lambda h: ~F.exists(taken, lambda t: t["note"] == h["note"]))
        mine = F.array(F.struct(one["parent"].alias("parent"), F.get(free, 0)["note"].alias("note")))
        return F.when(F.size(free) > 0, F.concat(taken, mine)).otherwise(taken)

    seen = layer = roots.select("root", "note", F.lit(0).alias("depth"), F.lit(1).alias("visit"))
    for depth in range(1, max_depth + 1):
        found = layer.select("root", F.col("note").alias("a"), F.col("visit").alias("parent")).join(near, "a").join(seen.select("root", "note"), ["root", "note"], "left_anti")
        met = found.filter("big").groupBy("root", "parent").agg(F.array_sort(F.collect_list(F.struct((-F.col("n_in")).alias("o"), "note"))).alias("hubs"))
        dealt = met.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("parent", "hubs"))).alias("all")).select("root", F.explode(F.aggregate("all", none, deal)).alias("t"))
        found = found.join(dealt.select("root", F.col("t.parent").alias("parent"), F.col("t.note").alias("hub")), ["root", "parent"], "left").filter("hub is null or hub = note")
        found = found.withColumn("_rn", F.row_number().over(W.partitionBy("root", "note").orderBy("parent"))).filter("_rn = 1")
        place = F.row_number().over(W.partitionBy("root").orderBy("parent", F.desc("n_in"), "note"))
        base = seen.groupBy("root").agg(F.max("visit").alias("_base"))
        layer = found.withColumn("_place", place).filter(F.col("_place") <= max_nodes).join(base, "root").withColumn("visit", (F.col("_base") + F.col("_place")).cast("int")).filter(F.col("visit") <= max_nodes)
        layer = materialised(layer.select("root", "note", F.lit(depth).alias("depth"), "visit"))
        seen = seen.unionByName(layer)
    return seen


def downward_search(edges: DataFrame, roots: DataFrame, max_depth: int = 2, max_nodes: int = 12) -> DataFrame:
    """root, note, depth, visit: along the links, notes with about five links first."""
    return layered_search(edges, roots, max_depth, max_nodes, "down", [F.desc(priority_score("exhaustive", F.col("n_in"), F.col("n_out"))), F.col("note")])


def walk(edges: DataFrame, roots: DataFrame, direction: str, max_depth: int, max_nodes: int) -> DataFrame:
    """The search of a direction that query_intent gives; any other is bidirectional."""
    if direction == "up":
        return upward_search(edges, roots, max_depth, max_nodes)
    if direction == "down":
        return downward_search(edges, roots, max_depth, max_nodes)
    return layered_search(edges, roots, max_depth, max_nodes)


def nearest_hubs(edges: DataFrame, roots: DataFrame, max_depth: int = 3) -> DataFrame:
    """root, hub: the nearest hub upwards (itself included), else the biggest of the graph; no row without any hub.

    Each root stops at its first layer with a hub; of several hubs there the one met first counts, and of the biggest
    ones of the graph the first by name.
    """
    edges = materialised(edges.select("src", "dst"))
    hubs = materialised(edges.groupBy(F.col("dst").alias("note")).agg(F.count(F.lit(1)).alias("n_in")).filter("n_in > 5"))
    seen = layer = materialised(roots.select("root", "note", F.lit(1).cast("long").alias("visit")))
    nearest = None
    for depth in range(max_depth + 1):
        if depth:
            found = _neighbours(edges, layer, seen, "up")
            layer = materialised(found.select("root", "note", F.row_number().over(W.partitionBy("root").orderBy("parent", "note")).cast("long").alias("visit")))
            seen = seen.unionByName(layer)
        met = materialised(layer.join(hubs.select("note"), "note", "left_semi").groupBy("root").agg(F.min_by("note", "visit").alias("_near")))
        nearest = met if nearest is None else nearest.unionByName(met)
        layer = materialised(layer.join(met.select("root"), "root", "left_anti"))
        if layer.isEmpty():
            break
    biggest = hubs.orderBy(F.desc("n_in"), "note").limit(1).select(F.col("note").alias("_big"))  # one row
    return roots.select("root").join(nearest, "root", "left").join(F.broadcast(biggest), F.lit(True), "left").select("root", F.coalesce("_near", "_big").alias("hub")).filter("hub is not null")


def hub_first_search(edges: DataFrame, roots: DataFrame, max_depth: int = 2, max_nodes: int = 15) -> DataFrame:
    """root, note, depth, visit: the root, then its nearest hub one layer down and what lies around that."""
    hubs = materialised(nearest_hubs(edges, roots))
    around = layered_search(edges, hubs.select("root", F.col("hub").alias("note")), max_depth - 1, max_nodes)
    own = roots.select("root", "note", F.lit(0).alias("depth"), F.lit(1).alias("visit"))
    return own.unionByName(around.join(own.select("root", "note"), ["root", "note"], "left_anti").select("root", "note", (F.col("depth") + 1).alias("depth"), (F.col("visit") + 1).alias("visit")))


def best_per_layer(layers: DataFrame, per_layer: int = 5, total: int = 8, deepest_first: bool = False) -> DataFrame:
    """The first notes of each layer but the root's, up to a total per root, near layers first unless told otherwise."""
    rows = layers.filter("depth > 0").withColumn("_n", F.row_number().over(W.partitionBy("root", "depth").orderBy("visit"))).filter(F.col("_n") <= per_layer)
    order = F.desc("depth") if deepest_first else F.asc("depth")
    rows = rows.withColumn("place", F.row_number().over(W.partitionBy("root").orderBy(order, "visit"))).filter(F.col("place") <= total)
    return rows.drop("_n")


def context_summary(layers: DataFrame, names: int = 10) -> DataFrame:
    """root, summary: how many notes, and per layer the first names and how many more there are."""
    of = layers.groupBy("root", "depth").agg(F.transform(F.array_sort(F.collect_list(F.struct("visit", "note"))), lambda x: x["note"]).alias("notes"))
    more = F.when(F.size("notes") > names, F.concat(F.lit(" (+"), (F.size("notes") - names).cast("string"), F.lit(")"))).otherwise("")
    line = F.concat(F.lit("Level "), F.col("depth").cast("string"), F.lit(": "), F.array_join(F.slice("notes", 1, names), ", "), more)
    of = of.select("root", "depth", F.size("notes").alias("_n"), line.alias("line"))
    whole = of.groupBy("root").agg(F.sum("_n").alias("n"), F.array_sort(F.collect_list(F.struct("depth", "line"))).alias("lines"))
    return whole.select("root", F.concat(F.lit("From "), "root", F.lit(", notes: "), F.col("n").cast("string"), F.lit("\n"), F.array_join(F.transform("lines", lambda x: x["line"]), "\n")).alias("summary"))


def note_closure(chosen: DataFrame, edges: DataFrame, vault: DataFrame) -> DataFrame:
    """note: the chosen notes and those of the vault that they link to."""
    linked = edges.join(chosen.select(F.col("note").alias("src")).distinct(), "src", "left_semi").select(F.col("dst").alias("note")).distinct()
    return chosen.select("note").unionByName(linked.join(vault.select("note"), "note", "left_semi")).distinct()


# What a query must hold to ask for context, details or everything, and how specific it is.
CONTEXT = (r"\b(qu[eé] es|define|explica|contexto de)\b", r"\b(para qu[eé] sirve|cu[aá]l es el prop[oó]sito)\b", r"\b(arquitectura|overview|visi[oó]n general)\b", r"\b(relacionado con|parte de)\b", r"\b(qu[eé] contiene|qu[eé] incluye)\b")
DETAIL = (r"\b(qu[eé] aplicaciones|qu[eé] servicios|qu[eé] programas)\b", r"\b(lista|enumerate|muestra)\b", r"\b(cu[aá]les son|cu[aá]ntos|nombres de)\b", r"\b(especificaciones|detalles|configuraci[oó]n de)\b", r"\b(usa|utiliza|depende de|consume)\b")
EXHAUSTIVE = (r"\b(toda la|completo|exhaustivo|todo sobre)\b", r"\b(diagrama|mapa|estructura completa)\b", r"\b(relaciones|dependencias|conexiones)\b", r"\b(flujo completo|end-to-end)\b")
SPECIFIC = r"\b(aplicaci[oó]n|servicio|programa|archivo|clase)\s+[A-Z]"
GENERAL = r"\b(todo|general|overview|arquitectura|contexto)\b"


def query_intent(query: Column, is_hub: Column, is_index: Column, note_type: Column) -> dict[str, Column]:
    """direction, max_depth, max_nodes, priority and confidence for walking the graph from a note."""
    low = F.lower(query)

    def hit(pattern: str) -> Column:
        return low.rlike(f"(?iU){pattern}").cast("int")

    exact, broad = hit(SPECIFIC), hit(GENERAL)
    note_up = F.when(~is_hub & (note_type == "atomic"), 1).otherwise(0)
    up = 2 * sum(map(hit, CONTEXT), F.lit(0)) + (broad > exact).cast("int") + note_up
    down = 2 * sum(map(hit, DETAIL), F.lit(0)) + (exact > broad).cast("int") + is_hub.cast("int")
    both = 3 * sum(map(hit, EXHAUSTIVE), F.lit(0)) + (~is_hub & (note_type != "atomic") & is_index).cast("int")
    most = F.greatest(up, down, both)
    direction = F.when(most == 0, "bidirectional").when(up == most, "up").when(down == most, "down").otherwise("bidirectional")
    confidence = F.when(most == 0, 0.3).otherwise(F.least(most / 5.0, F.lit(1.0)))
    return {
        "direction": direction,
        "confidence": confidence,
        "max_depth": F.when(direction == "up", F.when(confidence > 0.7, 2).otherwise(3)).when((direction == "down") & (exact > broad), 3).otherwise(2),
        "max_nodes": F.when(direction == "up", 8).when(direction == "down", F.when(exact > broad, 10).otherwise(12)).otherwise(15),
        "priority": F.when(direction == "up", "general").when(direction == "down", "specific").otherwise("exhaustive"),
    }
