"""Ingestion of files into a versioned store: points, word counts and a ledger, with errors as rows and observed tallies.

A store is a folder of tables. Each run writes one batch of every table under its number, the ledger last, so that a run
that failed is not seen and replaces what it wrote when it runs again. Nothing is changed in place: what is current is
what the newest ledger row of a path says, deleted paths have a tombstone, and compaction writes a new generation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import extension, tokenize, word_counts
from quillspark.operators.chunking import boundary_chunks
from quillspark.operators.retrieval import index_of
from quillspark.operators.stages import saved
from quillspark.sources.formats import TEXT_PLANS, sections_of, valid_json
from quillspark.sources.sections import decoded, loader_of

TABLES = {
    "points": "id string, path string, place int, chunk_index int, section string, level int, content string, embedding_text string, embedding array<double>, version long",
    "words": "id string, dl int, terms array<struct<term:string,tf:long>>, path string, version long",
    "ledger": "path string, status string, action string, hash string, modified timestamp, length long, n_sections long, n_chunks long, error string, version long",
}
#: Up to so many keys are broadcast; more are hashed beside a shuffle of what they are kept from. Neither sorts a text.
BROADCAST_ROWS = 500_000
#: Files above this size are refused.
MAX_BYTES = 50 << 20


class Store:
    """The tables below a folder that all executors share."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, path: str, schema: str) -> DataFrame:
        place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if place.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(place):
            return self.spark.read.schema(schema).parquet(path)
        return self.spark.createDataFrame([], schema)  # nothing has been written yet

    def generation(self) -> int:
        return self._read(f"{self.path}/generations", "generation int").agg(F.max("generation")).first()[0] or 0

    def read(self, table: str) -> DataFrame:
        """All rows of a table's generation, old versions and tombstones among them."""
        return self._read(f"{self.path}/generation={self.generation()}/{table}", TABLES[table])

    def write(self, table: str, rows: DataFrame, batch: int, generation: int | None = None) -> str:
        path = f"{self.path}/generation={self.generation() if generation is None else generation}/{table}/batch={batch}"
        columns = [f.split()[0] for f in TABLES[table].split(", ")]
        saved(rows.select(*columns), path)
        return path

    def ledger(self) -> DataFrame:
        """Of each path the newest row that is no error; an error leaves what was there before."""
        rows = self.read("ledger").filter("status <> 'error'")
        newest = rows.groupBy("path").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "path"]), "version").alias("r"))
        return newest.select("path", "r.*").filter("status = 'completed'")

    def totals(self) -> DataFrame:
        """One row: files, sections and vectors that are current."""
        return self.ledger().agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("n_sections"), F.lit(0)).alias("sections"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("vectors"))

    def failures(self) -> DataFrame:
        """Paths whose newest row is an error, with that error."""
        newest = self.read("ledger").groupBy("path").agg(F.max_by(F.struct("status", "error", "version"), "version").alias("r"))
        return newest.select("path", "r.*").filter("status = 'error'").drop("status")

    def statuses(self, files: DataFrame) -> DataFrame:
        """path, status, n_chunks, error of files (path, hash): pending until a run has seen this hash, then how that run ended."""
        newest = self.read("ledger").groupBy("path").agg(F.max_by(F.struct("status", "hash", "n_chunks", "error"), "version").alias("r")).select("path", "r.*")
        both = files.select("path", F.col("hash").alias("now")).join(newest, "path", "left")
        seen = F.coalesce(F.col("hash") == F.col("now"), F.lit(False)) & (F.col("status") != "deleted")
        return both.select("path", F.when(seen, F.col("status")).otherwise("pending").alias("status"), F.when(seen, F.col("n_chunks")).alias("n_chunks"), F.when(seen, F.col("error")).alias("error"))

    def _current(self, table: str, *columns: str | Column) -> DataFrame:
        rows = self.read(table).select("path", "version", *(columns or [c.split()[0] for c in TABLES[table].split(", ") if c.split()[0] not in ("path", "version")]))
        runs = [r["version"] for r in self.read("ledger").select("version").distinct().collect()]  # a run that failed has no ledger
        rows, old = rows.filter(F.col("version").isin(runs)), self._superseded()
        n = old.count()
        if n == 0:
            return rows
        return rows.join(F.broadcast(old) if n <= BROADCAST_ROWS else old.hint("shuffle_hash"), ["path", "version"], "left_anti")

    def _superseded(self) -> DataFrame:
        """path and version of what landed once and was updated or deleted since."""
        rows = self.read("ledger").filter("status <> 'error'")
        landed = F.collect_set(F.when(F.col("status") == "completed", F.col("version")))
        each = rows.groupBy("path").agg(F.max("version").alias("newest"), landed.alias("landed"))
        return saved(each.select("path", F.explode(F.filter("landed", lambda v: v < F.col("newest"))).alias("version")))

    def points(self, *columns: str | Column) -> DataFrame:
        """The current points; with columns, path, version and these, which are made before anything is shuffled."""
        return self._current("points", *columns)

    def index(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        """The BM25 index over the current points, from their saved word counts; no text is split again."""
        return index_of(saved(self._current("words", "id", "dl", "terms").drop("path", "version")))

    def compact(self) -> int:
        """Write what is current, and the errors that still stand, as a new generation; returns its number.

        Runs of this store must not overlap a compaction. Readers see the new generation once all its tables are there;
        older ones stay until they are removed.
        """
        old = self.generation()
        rows = self.read("ledger")
        stands = self.failures().select("path", "version")
        tables = {"points": self.points(), "words": self._current("words"), "ledger": self.ledger().unionByName(rows.join(stands, ["path", "version"], "left_semi").filter("status = 'error'"))}
        for table, current in tables.items():
            self.write(table, current, 0, old + 1)
        self.spark.createDataFrame([(old + 1,)], "generation int").coalesce(1).write.mode("append").parquet(f"{self.path}/generations")
        return old + 1


def refusal(path: Column, loader: Column, length: Column, text: Column, max_bytes: int = MAX_BYTES) -> Column:
    """Why a file cannot be ingested; null if it can."""
    return (
        F.when(loader.isNull(), F.concat(F.lit("no loader for: "), F.coalesce(extension(path), F.lit(""))))
        .when(~loader.isin(*TEXT_PLANS), F.concat(F.lit("no text plan for: "), loader))
        .when(length > max_bytes, F.lit(f"larger than {max_bytes} bytes"))
        .when(F.trim(text) == "", F.lit("no text"))
        .when((loader == "json") & ~valid_json(text), F.lit("no valid JSON"))
    )


def ingest(
    files: DataFrame,
    store: Store,
    batch: int,
    listing: DataFrame | None = None,
    embed: Callable[[Column], Column] | None = None,
    chunk: Callable[[DataFrame], DataFrame] | None = None,
    max_bytes: int = MAX_BYTES,
) -> dict[str, int]:
    """One run: new and modified files become points and word counts, the ledger tells how each file ended.

    files: path, content (bytes or text), and modified and length if known; listing: all paths that exist, by default
    those of files. Paths that the ledger has and the listing has not are deleted. A file that cannot be ingested is a
    row with status error and its reason, keeps its former version, and is tried again by the next run; all others land.
    Returns the tally: processed, added, updated, deleted, skipped, errors. Null paths are left out; a path that
    occurs more than once is ingested once, by its greatest hash; no files with no listing delete everything that is there.

    The source is read once: what has changed is cut into the checkpoint folder, points are written, and words and counts are made of
    the written points. embed makes a vector of a text (column to column); chunk cuts sections (id, text) into chunks and
    hands id on, which is what is known of the section. Texts are shuffled only to meet a ledger that has rows, and not sorted.
    """
    files = files.filter("path is not null")
    text = decoded(F.col("content")) if dict(files.dtypes)["content"] == "binary" else F.coalesce("content", F.lit(""))
    size = F.col("length") if "length" in files.columns else F.octet_length("content").cast("long")
    modified = F.col("modified") if "modified" in files.columns else F.lit(None).cast("timestamp")
    seen = files.select("path", text.alias("content"), F.coalesce(size, F.lit(0)).cast("long").alias("length"), modified.alias("modified"))
    seen = seen.withColumns({"loader": loader_of(F.col("path")), "hash": F.sha2("content", 256)})
    ledger = saved(store.ledger().select("path", F.col("hash").alias("old")))
    both = seen.withColumn("old", F.lit(None).cast("string")) if ledger.isEmpty() else seen.join(ledger.hint("shuffle_hash"), "path", "left")
    action = F.when(F.col("old").isNull(), "new").when(F.col("old") != F.col("hash"), "modified").otherwise("unchanged")
    both = both.withColumn("action", action)
    changed = F.col("action") != "unchanged"
    error = F.when(changed, refusal(F.col("path"), F.col("loader"), F.col("length"), F.col("content"), max_bytes))
    work = both.withColumn("error", error).withColumn("content", F.when(changed & F.col("error").isNull(), F.col("content")))
    columns = ("content", "length", "modified", "loader", "hash", "action", "error")
    work = saved(work.select("path", *columns))
    repeated = work.groupBy("path").count().filter("count > 1").select("path")
    if not repeated.isEmpty():  # only their rows are grouped
        repeated = saved(repeated)
        one = work.join(repeated, "path", "left_semi").groupBy("path").agg(F.max_by(F.struct(*columns), "hash").alias("r")).select("path", "r.*")
        work = saved(work.join(repeated.hint("shuffle_hash"), "path", "left_anti").unionByName(one))

    sections = sections_of(work.filter("content is not null")).filter("content <> ''")
    cut = chunk or (lambda rows: boundary_chunks(rows, 1000, 200, "id", "text"))
    known = F.struct("path", "place", F.col("title").alias("section"), "level").alias("id")
    chunks = cut(sections.select(known, F.concat_ws("\n\n", "title", "content").alias("text"))).select("id.*", "chunk_index", F.col("content").alias("piece"))
    rows = chunks.withColumn("embedding_text", F.concat_ws("\n\n", "section", "piece"))
    vector = embed(F.col("embedding_text")) if embed else F.lit(None)
    points = rows.select(
        F.md5(F.concat_ws("#", "path", "place", "chunk_index")).alias("id"), "path", "place", "chunk_index", "section", "level", F.col("piece").alias("content"), "embedding_text", vector.cast("array<double>").alias("embedding"), F.lit(batch).cast("long").alias("version")
    )
    written = store.spark.read.parquet(store.write("points", points, batch))
    words = written.select("id", "path", "version", tokenize(F.col("content")).alias("words"))
    store.write("words", words.select("id", "path", "version", F.size("words").alias("dl"), word_counts(F.col("words")).alias("terms")), batch)

    counts = written.groupBy("path").agg(F.count_distinct("place").alias("n_sections"), F.count(F.lit(1)).alias("n_chunks"))
    done = work.drop("content", "loader").join(counts, "path", "left").na.fill(0, ["n_sections", "n_chunks"])
    why = F.coalesce("error", F.when((F.col("action") != "unchanged") & (F.col("n_chunks") == 0), F.lit("no sections")))
    done = done.withColumn("error", why).withColumn("status", F.when(F.col("error").isNull(), "completed").otherwise("error"))
    exist = files.select("path") if listing is None else listing.select("path")
    gone = ledger.join(exist, "path", "left_anti").select("path", F.lit("deleted").alias("action"), F.lit("deleted").alias("status"), F.col("old").alias("hash"))
    every = done.unionByName(gone, allowMissingColumns=True).na.fill(0, ["n_sections", "n_chunks"]).withColumn("version", F.lit(batch).cast("long"))
    ok = F.col("status") == "completed"
    tally = {"added": ok & (F.col("action") == "new"), "updated": ok & (F.col("action") == "modified"), "deleted": F.col("action") == "deleted", "skipped": F.col("action") == "unchanged", "errors": F.col("status") == "error"}
    watch = Observation("ingest")
    observed = every.observe(watch, *[F.coalesce(F.sum(F.when(c, 1)), F.lit(0)).alias(n) for n, c in tally.items()])
    store.write("ledger", observed.filter("action <> 'unchanged'"), batch)
    told = {n: int(watch.get[n]) for n in tally}
    return {"processed": told["added"] + told["updated"], **told}


def sync_folder(spark: SparkSession, root: str, store: Store, batch: int, **options) -> dict[str, int]:
    """One run over the visible files below root: only files that are new or have another time or size are read in full."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    listed = listed.filter(~F.col("path").rlike(r"/\.[^/]"))
    known = store.ledger().select("path", F.col("modified").alias("_time"), F.col("length").alias("_size"))
    facts = listed.select("path", F.col("modificationTime").alias("modified"), "length")
    changed = facts.join(known, "path", "left").filter(~(F.col("modified").eqNullSafe(F.col("_time")) & F.col("length").eqNullSafe(F.col("_size"))))
    span = changed.agg(F.min("modified"), F.count(F.lit(1))).first()
    skipped = facts.count() - span[1]
    files = listed.select("path", "content", F.col("modificationTime").alias("modified"), "length")
    if span[1]:  # the source skips older files without reading them
        files = files.filter(F.col("modified") >= F.lit(span[0]))
    files = files.join(changed.select("path"), "path", "left_semi")
    told = ingest(files, store, batch, listing=facts, **options)
    return told | {"skipped": told["skipped"] + skipped}
