"""Folders of notes: which vault a path is in, authors that tables name, and the text of related notes for an answer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.metadata import AUTHOR_HEADERS, PREPARED, collapsed, is_history
from quillspark.operators.retrieval import cosine

MARKER = ".obsidian"


def parent_of(path: Column) -> Column:
    return F.regexp_replace(path, r"/?[^/]*$", "")


def ancestors(folder: Column, levels: int = 5) -> Column:
    """A folder and those above it, at most `levels` in all, as an array from near to far; the root of the file system is not among them."""
    found = [folder]
    for _ in range(levels - 1):
        found.append(parent_of(found[-1]))
    return F.array_distinct(F.filter(F.array(*found), lambda x: x != ""))


def vault_roots(paths: DataFrame, path_col: str = "path", marker: str = MARKER) -> DataFrame:
    """root: folders that hold the marker folder, from any listing of files (or folders) below them."""
    inside = F.regexp_extract(F.col(path_col), rf"^(.*?)/{marker.replace('.', '[.]')}(?:/|$)", 1)
    return paths.select(inside.alias("root")).filter("root <> ''").distinct()


def detect(asked: DataFrame, paths: DataFrame, path_col: str = "path", levels: int = 5, marker: str = MARKER) -> DataFrame:
    """path, type, vault_root, is_vault, n_notes of each asked path: a file, or a folder of the listing `paths`.

    A folder with the marker is a vault with its visible notes; another folder with notes below it is a subset; a note is
    a single file. The vault of these two is the nearest of their at most `levels` folders upwards with a marker. Anything
    else is a single file without notes. Null paths and repeated ones are left out.
    """
    asked = asked.select(F.regexp_replace(path_col, r"(?<=.)/$", "").alias("path")).filter("path is not null").distinct()
    roots = vault_roots(paths, path_col, marker)
    notes = paths.select(F.col(path_col).alias("file")).filter(F.col("file").endswith(".md")).distinct()
    # each note counts for all folders above it: visible ones, whose rest of the path has no hidden part, and all
    above = notes.select("file", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(F.split("file", "/")) - 1), lambda k: F.array_join(F.slice(F.split("file", "/"), F.lit(1), k), "/")))).alias("path"))
    above = above.filter("path <> ''").withColumn("seen", ~F.substr(F.col("file"), F.length("path") + 1).rlike(r"/[.]"))
    counts = above.groupBy("path").agg(F.count(F.lit(1)).alias("n_all"), F.count_if("seen").alias("n_seen"))
    own = asked.join(notes.withColumnRenamed("file", "path").withColumn("is_note", F.lit(True)), "path", "left").join(counts, "path", "left").join(roots.select(F.col("root").alias("path"), F.lit(True).alias("is_root")), "path", "left")
    folder = F.when(F.col("is_note"), parent_of(F.col("path"))).when(F.col("n_all") > 0, F.col("path"))
    near = own.select("path", F.posexplode(ancestors(folder, levels)).alias("level", "root")).join(roots, "root")
    near = near.groupBy("path").agg(F.min_by("root", "level").alias("near"))
    out = own.join(near, "path", "left")
    kind = F.when(F.col("is_root"), "vault").when(F.col("is_note"), "single_file").when(F.col("n_all") > 0, "subset").otherwise("single_file")
    root = F.when(F.col("is_root"), F.col("path")).otherwise(F.col("near"))
    n = F.when(F.col("is_root"), F.col("n_seen")).when(F.col("is_note"), 1).otherwise(F.coalesce("n_all", F.lit(0)))
    return out.select("path", kind.alias("type"), root.alias("vault_root"), root.isNotNull().alias("is_vault"), F.coalesce(n, F.lit(0)).cast("long").alias("n_notes"))


def table_authors(cells: DataFrame) -> DataFrame:
    """path, author, authors, has_history from the cells of a document's tables (path, table, row, col, text; rows and cols from 0).

    Candidates are what stands below the first header that says author, then the second cell of rows that begin with
    preparation, table by table and row by row; the author is the first, authors are all of them, each once. White space
    is collapsed and empty cells count for nothing. A document without candidates has no author and an empty list.
    """
    low = F.lower(collapsed(F.col("text")))
    rows = cells.select("path", "table", "row", "col", collapsed(F.col("text")).alias("text"), low.alias("low"))
    heads = rows.filter("row = 0").groupBy("path", "table").agg(F.min(F.when(F.col("low").isin(*AUTHOR_HEADERS), F.col("col"))).alias("at"), F.collect_set("low").alias("headers"))
    below = rows.filter("row > 0").join(heads.filter("at is not null").select("path", "table", F.col("at").alias("col")), ["path", "table", "col"]).select("path", F.struct("table", F.lit(0).alias("kind"), "row").alias("place"), "text")
    line = rows.filter("row > 0 and col <= 1").groupBy("path", "table", "row").agg(F.max(F.when(F.col("col") == 0, F.col("low"))).alias("first"), F.max(F.when(F.col("col") == 1, F.col("text"))).alias("text"))
    prepared = line.filter(F.col("first").isin(*PREPARED)).select("path", F.struct("table", F.lit(1).alias("kind"), "row").alias("place"), "text")
    found = below.unionByName(prepared).filter("text <> ''").groupBy("path", "text").agg(F.min("place").alias("place"))
    named = found.groupBy("path").agg(F.min_by("text", "place").alias("author"), F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]).alias("authors"))
    every = heads.groupBy("path").agg(F.max(is_history(F.col("headers"))).alias("has_history"))
    return every.join(named, "path", "left").select("path", "author", F.coalesce("authors", F.array().cast("array<string>")).alias("authors"), "has_history")


def related_texts(picks: DataFrame, asked: Sequence[tuple[str, Sequence[float]]], chunks: DataFrame, threshold: float = 0.25, chars: int = 350) -> DataFrame:
    """picks with the best chunk of each note's own question: id, score and content, cut to `chars`; picks without one go.

    picks: root, note, depth, place (graph.best_per_layer); asked: each note with the vector of note and question together;
    chunks: id, content, embedding. Every chunk is scored once for all notes; a note keeps one row per task, ties by id.
    """
    if not asked:
        return picks.limit(0).select("*", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("score"), F.lit("").alias("content"))
    names = F.array(*[F.lit(n) for n, _ in asked])
    scores = F.array(*[F.round(cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in v])), 6) for _, v in asked])
    near = chunks.select("id", "content", F.posexplode(scores).alias("k", "score")).filter(F.col("score") >= threshold)
    best = near.groupBy("k").agg(F.min_by(F.struct("id", "score", F.substring("content", 1, chars).alias("content")), F.struct(-F.col("score"), "id")).alias("b"))
    found = best.select(F.get(names, F.col("k")).alias("note"), "b.*")
    return picks.join(F.broadcast(found), "note")  # a row per note asked for


def expanded_context(related: DataFrame, direction: Column) -> DataFrame:
    """root, context: the texts of related notes in order of place, each under its note and level, rules between them."""
    mark = F.when(direction == "up", "↑").when(direction == "down", "↓").otherwise("↔")
    part = F.concat(F.lit("**"), mark, F.lit(" [Nivel "), F.col("depth").cast("string"), F.lit("] "), F.col("note"), F.lit("**\n"), F.col("content"), F.lit("\n"))
    parts = related.groupBy("root").agg(F.array_sort(F.collect_list(F.struct("place", part.alias("t")))).alias("x"))
    return parts.select("root", F.array_join(F.transform("x", lambda x: x["t"]), "\n---\n\n").alias("context"))
