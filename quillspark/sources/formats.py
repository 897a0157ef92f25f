"""Sections of JSON, HTML, SQL and CSV as column plans, and one plan for a table of files of any of the text formats."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import strip
from quillspark.sources.sections import _by_heading, code_sections, markdown_sections, text_sections

SECTION = ("place", "title", "content", "level")


def _json_lines(text: Column) -> Column:
    """Lines of a text that has several, each a JSON value by itself; else null."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.when((F.size(lines) > 1) & F.forall(lines, lambda x: F.try_parse_json(x).isNotNull()), lines)


def valid_json(text: Column) -> Column:
    """True if a text is JSON lines or one JSON value."""
    return _json_lines(text).isNotNull() | F.try_parse_json(text).isNotNull()


def _json_text(value: Column, depth: int = 5) -> Column:
    """A JSON value as lines: keys of objects with what they hold, deeper levels indented, cut below a depth."""
    if depth < 0:
        return F.lit("[Max depth reached]")

    def shown(key: Column, inner: Column) -> Column:
        nested = inner.rlike(r"^\s*[\[{]")
        below = F.concat(F.lit("  "), F.regexp_replace(_json_text(inner, depth - 1), "\n", "\n  "))
        return F.when(nested, F.concat(key, F.lit(":\n"), below)).otherwise(F.concat(key, F.lit(": "), F.coalesce(inner, F.lit("None"))))

    entries = F.map_entries(F.from_json(value, "map<string,string>"))
    items = F.from_json(value, "array<string>")
    of_object = F.array_join(F.transform(entries, lambda e: shown(e["key"], e["value"])), "\n")
    of_list = F.array_join(F.transform(items, lambda x, i: shown(F.concat(F.lit("["), i.cast("string"), F.lit("]")), x)), "\n")
    return F.when(value.rlike(r"^\s*\{"), of_object).when(value.rlike(r"^\s*\["), of_list).otherwise(value)


def json_sections(docs: DataFrame, key: str = "path", text: str = "content", depth: int = 2) -> DataFrame:
    """A section per item of a list or line of JSON lines, or per top key of an object; what is no JSON has none.

    An item's title is its title, name, id or key, else its first entry, else its number. Values deeper than `depth`
    levels are cut; a plan grows with depth, so it is small.
    """
    body = F.trim(F.col(text))
    lines = _json_lines(body)
    whole = lines.isNull() & F.try_parse_json(body).isNotNull()
    items = F.when(whole & body.startswith("["), F.from_json(body, "array<string>")).otherwise(lines)
    parts = docs.select(key, F.posexplode(items).alias("place", "item"))
    keys = F.json_object_keys("item")
    named = [F.when(F.array_contains(keys, k), F.concat(F.lit(f"{k}: "), F.get_json_object("item", f"$.{k}"))) for k in ("title", "name", "id", "key")]
    first = F.get(F.map_entries(F.from_json("item", "map<string,string>")), F.lit(0))
    title = F.coalesce(*named, F.concat(first["key"], F.lit(": "), first["value"]), F.concat(F.lit("Item "), F.col("place") + 1))
    of_items = parts.select(key, "place", title.alias("title"), _json_text(F.col("item"), depth).alias("content"))
    entries = F.when(whole & body.startswith("{"), F.map_entries(F.from_json(body, "map<string,string>")))
    of_object = docs.select(key, F.posexplode(entries).alias("place", "e")).select(key, "place", F.col("e.key").alias("title"), _json_text(F.col("e.value"), depth).alias("content"))
    return of_items.unionByName(of_object).withColumn("level", F.lit(1))


# Elements whose text is no content, and elements that end a line.
_SKIP = ("script", "style", "nav", "footer", "aside")
_LINES = "p|div|li|td|th|tr|br|ul|ol|table|section|article|main|body|html|head|header|title"
_ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&amp;": "&"}


def html_lines(html: Column) -> Column:
    """The text of main, article or body, a line per block; a heading's line begins with a control character and its level."""
    parts = [F.nullif(F.regexp_extract(html, rf"(?is)<{tag}\b.*{end}", 0), F.lit("")) for tag, end in (("main", "</main>"), ("article", "</article>"), ("body", ""))]
    x = F.regexp_replace(F.coalesce(*parts, html), r"(?s)<!--.*?-->", "")
    for tag in _SKIP:
        x = F.regexp_replace(x, rf"(?is)<{tag}\b.*?</{tag}\s*>", "")
    x = F.regexp_replace(x, r"[\s\x00-\x1f]+", " ")
    for level in range(1, 7):
        x = F.regexp_replace(x, rf"(?i)<h{level}\b[^>]*>", f"\n\x01{level}")
        x = F.regexp_replace(x, rf"(?i)</h{level}\s*>", "\n")
    x = F.regexp_replace(F.regexp_replace(x, rf"(?i)</?(?:{_LINES})\b[^>]*>", "\n"), r"<[A-Za-z/!][^>]*>", "")
    for name, char in _ENTITIES.items():
        x = F.replace(x, F.lit(name), F.lit(char))
    return F.filter(F.transform(F.split(x, "\n"), lambda line: strip(line)), lambda line: F.regexp_replace(line, "^\x01[1-6]$", "") != "")


def html_sections(pages: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """Headings start sections, the lines of blocks fill them; what stands before the first is the Introduction, level 0."""
    lines = pages.select(key, F.posexplode(html_lines(F.col(text))).alias("n", "line"))
    head = F.col("line").startswith("\x01")
    return _by_heading(lines, key, head, strip(F.substring("line", 3, 1 << 30)), F.substring("line", 2, 1).cast("int"), "Introduction")


# What a CREATE statement makes.
_MADE = r"PACKAGE\s+BODY|PACKAGE|FUNCTION|PROCEDURE|TYPE|TRIGGER|MATERIALIZED\s+VIEW|VIEW|SEQUENCE|TABLE|INDEX"
_CREATE = rf"\s*CREATE(?:\s+OR\s+REPLACE)?\s+({_MADE})\s+([\w.]+)"


def sql_sections(scripts: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """CREATE blocks up to the first semicolon that ends a line, and the plain statements between them.

    A block is titled by what it makes and its name, a statement by its first line or, from 100 characters on, its number.
    """
    block = rf"^{_CREATE}.*?(?:;(?=\s*(?:/\*|--|\n|\z))|\z)"
    plain = rf"(?:(?!^{_CREATE})[^;])+(?:;|\z|(?=^{_CREATE}))"
    found = F.regexp_extract_all(F.regexp_replace(F.col(text), r"\r\n?", "\n"), F.lit(rf"(?ims)(?:{block}|{plain})"), F.lit(0))
    parts = F.filter(F.transform(found, lambda x: strip(x)), lambda x: ~x.isin("", ";"))
    rows = scripts.select(key, F.posexplode(parts).alias("place", "content"))
    made = F.col("content").rlike(rf"(?i)\A{_CREATE}")
    kind = F.upper(F.regexp_replace(F.regexp_extract("content", rf"(?i)\A{_CREATE}", 1), r"\s+", "_"))
    line = F.trim(F.substring_index("content", "\n", 1))
    title = F.when(made, F.concat(kind, F.lit(": "), F.regexp_extract("content", rf"(?i)\A{_CREATE}", 2))).when(F.length(line) < 100, F.regexp_replace(line, r";\z", "")).otherwise(F.concat(F.lit("SQL_Statement_"), F.col("place") + 1))
    ended = F.when(F.col("content").endswith(";"), F.col("content")).otherwise(F.concat("content", F.lit(";")))
    return rows.select(key, "place", title.alias("title"), F.when(made, F.col("content")).otherwise(ended).alias("content"), F.when(made, 1).otherwise(2).alias("level"))


# --- CSV ----------------------------------------------------------------------------------------------------------

DELIMITERS = (",", ";", "\t", "|")


def sniffed(head: Column, delimiters: Sequence[str] = DELIMITERS) -> Column:
    """The delimiter of a CSV text's head: the one that stands most often, and equally often, in its first full lines; else a comma.

    Quoted fields are left out of the count.
    """
    lines = F.filter(F.slice(F.split(F.regexp_replace(head, r'"(?:[^"]|"")*"', ""), r"\r?\n"), 1, 20), lambda x: x != "")
    full = F.when(F.size(lines) > 2, F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)  # the last one may be cut

    def even(d: str) -> Column:
        counts = F.transform(full, lambda x: F.length(x) - F.length(F.replace(x, F.lit(d), F.lit(""))))
        return F.when((F.array_min(counts) > 0) & (F.array_min(counts) == F.array_max(counts)), F.array_min(counts)).otherwise(0)

    best = F.array_max(F.array(*[F.struct(even(d).alias("n"), F.lit(-i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(delimiters)]))
    return F.when(best["n"] > 0, best["d"]).otherwise(",")


def encoding_of(head: Column) -> Column:
    """Of the bytes of a head (its last character may be cut): UTF-8 if they are valid, else Latin-1."""
    whole = [F.try_validate_utf8(F.substring(head, 1, F.length(head) - k).cast("string")).isNotNull() for k in range(4)]
    fits = whole[0]
    for w in whole[1:]:
        fits = fits | w
    return F.when(fits, "UTF-8").otherwise("ISO-8859-1")


def csv_dialects(spark: SparkSession, root: str, head: int = 4096) -> DataFrame:
    """path, delimiter and encoding of each CSV file below root, from its first bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root)
    start = F.substring("content", 1, head)
    encoding = encoding_of(start)
    text = F.when(encoding == "UTF-8", start.cast("string")).otherwise(F.decode(start, "ISO-8859-1"))
    return files.select("path", sniffed(text).alias("delimiter"), encoding.alias("encoding"))


def read_csv(spark: SparkSession, root: str, size: int = 100) -> tuple[DataFrame, DataFrame]:
    """(files, sections) of the CSV files below root: a reader for every dialect that occurs, each file read by its own.

    files: path, delimiter, encoding, row_count, column_count, columns. sections: path, place, title, content (header, dashes
    and up to `size` rows with bars between values), level. A missing value is empty; a file with only a header has no section.
    """
    dialects = csv_dialects(spark, root)
    kinds = dialects.groupBy("delimiter", "encoding").agg(F.collect_list("path").alias("paths")).collect()  # file names, which Spark's reader lists on the driver too
    rows = None
    for d in kinds:
        part = spark.read.option("sep", d["delimiter"]).option("encoding", d["encoding"]).option("multiLine", True).option("escape", '"').option("header", False).csv(d["paths"])
        values = F.array(*[F.col(f"`{c}`") for c in part.columns])
        one = part.select(F.col("_metadata.file_path").alias("path"), values.alias("row"), F.monotonically_increasing_id().alias("at"), F.lit(d["delimiter"]).alias("delimiter"), F.lit(d["encoding"]).alias("encoding"))
        rows = one if rows is None else rows.unionByName(one)
    if rows is None:
        empty = "path string, delimiter string, encoding string, row_count long, column_count int, columns array<string>"
        return spark.createDataFrame([], empty), spark.createDataFrame([], "path string, place int, title string, content string, level int")
    order = W.partitionBy("path").orderBy("at")  # a file is one task of the reader anyway
    placed = rows.withColumn("n", F.row_number().over(order) - 1).withColumn("columns", F.first("row").over(order))
    placed = placed.withColumn("columns", F.filter("columns", lambda c: c.isNotNull()))
    files = placed.groupBy("path", "delimiter", "encoding").agg(F.max("n").cast("long").alias("row_count"), F.first("columns").alias("columns"))
    files = files.select("path", "delimiter", "encoding", "row_count", F.size("columns").alias("column_count"), "columns")
    line = F.array_join(F.transform(F.slice("row", F.lit(1), F.size("columns")), lambda v: F.coalesce(v, F.lit(""))), " | ")
    cells = placed.filter("n > 0").select("path", "columns", F.expr(f"(n - 1) div {size}").cast("int").alias("place"), "n", line.alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    parts = cells.groupBy("path", "place").agg(F.first("columns").alias("columns"), F.min("n").alias("a"), F.max("n").alias("b"), lines.alias("body")).join(files.select("path", "row_count"), "path")
    dashes = F.aggregate("columns", F.lit(0), lambda s, c: s + F.length(c) + 3)
    content = F.concat_ws("\n", F.array_join("columns", " | "), F.repeat(F.lit("-"), dashes), "body")
    few = F.concat(F.lit("CSV Data (1-"), F.col("row_count"), F.lit(" rows)"))
    title = F.when(F.col("row_count") <= size, few).otherwise(F.concat(F.lit("CSV Data (rows "), F.col("a"), F.lit("-"), F.col("b"), F.lit(")")))
    return files, parts.select("path", "place", title.alias("title"), content.alias("content"), F.lit(1).alias("level"))


#: Loaders whose files are text, each a plan from (path, content) to sections.
TEXT_PLANS: Mapping[str, object] = {"markdown": markdown_sections, "text": text_sections, "code": code_sections, "json": json_sections, "html": html_sections, "sql": sql_sections}


def sections_of(files: DataFrame) -> DataFrame:
    """path, place, title, content, level of files (path, loader, content as text), each by its loader's plan."""
    out = None
    for loader, plan in TEXT_PLANS.items():
        own = files.filter(F.col("loader") == loader).select("path", "content")
        part = plan(own).select("path", *[F.col(c).cast("int").alias(c) if c in ("place", "level") else c for c in SECTION])
        out = part if out is None else out.unionByName(part)
    return out


