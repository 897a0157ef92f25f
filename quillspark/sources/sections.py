"""Documents of many formats into sections: path, title, content, level, place. One DataFrame transform per format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import extension, strip
from quillspark.operators.stages import numbered

# Which loader takes which extension, in order of preference.
LOADERS = {
    "markdown": ("md",), "pdf": ("pdf",), "word": ("docx",), "excel": ("xlsx", "xlsm"), "powerpoint": ("pptx",), "csv": ("csv",), "json": ("json", "jsonl"),
    "html": ("html", "htm"), "text": ("txt",), "sql": ("sql", "pls", "pks", "pkb", "prc", "fnc", "plsql"), "code": ("py", "java", "cs", "js", "ts", "go"),
}


def loader_of(path: Column) -> Column:
    """Name of the loader for a path, null if none takes it."""
    out = F.lit(None).cast("string")
    for name, extensions in reversed(LOADERS.items()):
        out = F.when(extension(path).isin(*extensions), name).otherwise(out)
    return out


def supported_extensions() -> list[str]:
    return sorted({f".{e}" for own in LOADERS.values() for e in own})


def read_files(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """path, content (binary), loader of every supported file below root; hidden folders and files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    files = files.filter(~F.col("path").rlike(r"/\.[^/]")).withColumn("loader", loader_of(F.col("path"))).filter("loader is not null")
    return files.filter(F.col("path").rlike(pattern)) if pattern else files


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 if they are valid UTF-8, else as Latin-1."""
    return F.coalesce(F.try_validate_utf8(content.cast("string")), F.decode(content, "ISO-8859-1"))


def text_sections(docs: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """Paragraphs between blank lines. A first line under 100 characters titles a paragraph of several lines.

    A text without paragraphs is one section as it stands, titled by its beginning. Each text is split once.
    """
    bodies = F.filter(F.transform(F.split(text, "\n\n"), lambda x, i: F.struct(i.alias("place"), strip(x).alias("body"))), lambda p: p["body"] != "")
    none = F.array(F.struct(F.lit(0).alias("place"), F.lit(None).cast("string").alias("body")))
    rows = docs.select(key, text, bodies.alias("_parts"))
    rows = rows.select(key, text, F.explode(F.when(F.size("_parts") > 0, F.col("_parts")).otherwise(none)).alias("p")).select(key, text, "p.place", "p.body")
    first, rest = F.split("body", "\n")[0], F.regexp_replace("body", r"^[^\n]*\n?", "")
    titled = F.contains("body", F.lit("\n")) & (F.length(first) < 100)
    empty = F.col("body").isNull()
    title = F.when(empty, F.concat(F.substring(text, 1, 50), F.lit("..."))).when(titled, first).otherwise(F.concat(F.lit("Paragraph "), F.col("place") + 1))
    return rows.select(key, "place", title.alias("title"), F.when(empty, F.col(text)).when(titled, strip(rest)).otherwise(F.col("body")).alias("content"), F.lit(1).alias("level"))


def _by_heading(lines: DataFrame, key: str, heading: Column, title: Column, level: Column, intro: str) -> DataFrame:
    """Lines (key, n, line) into sections: a running count of headings numbers them, one window per document."""
    w = W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    marked = lines.withColumn("_h", heading).withColumn("place", F.sum(F.col("_h").cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("n", "line")))), lambda x: x["line"]), "\n")
    out = marked.groupBy(key, "place").agg(F.max(F.when(F.col("_h"), title)).alias("title"), F.max(F.when(F.col("_h"), level)).alias("level"), strip(body).alias("content"))
    return out.filter("content <> ''").select(key, "place", F.coalesce("title", F.lit(intro)).alias("title"), "content", F.coalesce("level", F.lit(0)).alias("level"))


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("n", "line"))


def markdown_sections(docs: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """Sections from one heading to the next; what stands before the first is the Introduction, level 0.

    Front matter is left out, sections without content are too; a text without headings is `Document Content`, and one
    with headings only, or without anything, is one section `General` as it stands. Each text is split once.
    """
    mark = r"^\s*(#{1,6})\s+(.+)$"
    bare = F.split(F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n?", ""), "\n")
    rows = docs.select(key, text, bare.alias("_lines"))
    full = F.coalesce(F.exists("_lines", lambda x: ~x.rlike(mark) & (strip(x) != "")), F.lit(False))
    rows = rows.select(key, full.alias("_full"), F.posexplode(F.when(full, F.col("_lines")).otherwise(F.array(F.col(text)))).alias("n", "line"))
    w = W.partitionBy(key).orderBy("n").rowsBetween(W.unboundedPreceding, 0)
    marked = rows.withColumn("_h", F.col("_full") & F.col("line").rlike(mark)).withColumn("place", F.sum(F.col("_h").cast("int")).over(w))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct("n", "line")))), lambda x: x["line"]), "\n")
    head = F.max(F.when(F.col("_h"), F.col("line")))
    own = F.when(F.first("_full"), strip(body)).otherwise(F.first("line"))
    out = marked.groupBy(key, "place").agg(head.alias("_head"), F.first("_full").alias("_full"), own.alias("content")).filter("not _full or content <> ''")
    # the rows of a key lie together already
    out = out.withColumn("_most", F.max("place").over(W.partitionBy(key)))
    title = F.when(~F.col("_full"), "General").when(F.col("_most") == 0, "Document Content").when(F.col("_head").isNull(), "Introduction").otherwise(F.trim(F.regexp_extract("_head", mark, 2)))
    level = F.when(~F.col("_full"), 1).otherwise(F.coalesce(F.length(F.regexp_extract("_head", mark, 1)), F.lit(0)))
    return out.select(key, "place", title.alias("title"), "content", level.alias("level"))


def front_matter(text: Column) -> Column:
    """Scalars and flat lists of the front matter as a map of strings; lists are joined by commas."""
    body = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)
    lists = F.regexp_replace(F.regexp_replace(body, r"(?m)\n\s*-\s+", ","), r":\s*,", ": ")
    pairs = F.filter(F.split(lists, "\n"), lambda x: x.rlike(r"^[^:#\s][^:]*:"))
    value = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, r"^[^:]*:", "")), "^[\"']|[\"']$", "")
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: F.substring_index(q, ":", 1) == F.substring_index(p, ":", 1)))
    return F.map_from_entries(F.transform(last, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), value(x))))


def section_api(title: Column, content: Column) -> dict[str, Column]:
    """HTTP verb of the title, first path in back quotes, and context, each null if absent."""
    verb = F.regexp_extract(F.upper(title), r"\b(GET|POST|PUT|PATCH|DELETE)\b", 1)
    return {"http_method": F.nullif(verb, F.lit("")), "endpoint": F.nullif(F.regexp_extract(content, r"`(/[\w\-/{}]+)`", 1), F.lit("")), "context": F.nullif(F.regexp_extract(content, r"Contexto:\s*(\w+)", 1), F.lit(""))}


PAGE_MARK = "[PÁGINA "


def page_text(pages: DataFrame, key: str = "path", page: str = "page", text: str = "text") -> DataFrame:
    """key, content: the pages of each document in order, each under a marker with its number; blank ones are left out."""
    own = strip(F.col(text))
    part = F.concat(F.lit(PAGE_MARK), F.col(page).cast("string"), F.lit("]\n"), own, F.lit("\n"))
    parts = pages.filter(own != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), part.alias("t")))).alias("x"))
    return parts.select(key, F.array_join(F.transform("x", lambda x: x["t"]), "\n").alias("content"))


def pdf_sections(pages: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """Lines of extracted page text into sections: numbered, upper-case and short stand-alone lines are headings, markers of pages go."""
    lines = lines_of(pages, key, text).filter(~F.trim("line").startswith(PAGE_MARK)).withColumn("_next", F.lead("line").over(W.partitionBy(key).orderBy("n")))
    line = F.trim("line")
    numbered = line.rlike(r"^\d+(\.\d+)*\.\s+.+$")
    upper = (line == F.upper(line)) & (F.lower(line) != line) & (F.size(F.split(line, r"\s+")) >= 2) & (F.length(line) < 100)
    short = (F.length(line) < 80) & (line != "") & ~line.rlike(r"[.,;:]$") & (F.length(F.trim("_next")) > 1.5 * F.length(line)) & ~line.rlike(r"^[-•*]") & line.rlike(r"^\p{Lu}")
    level = F.when(numbered, F.regexp_count(F.regexp_extract(line, r"^(\d+(\.\d+)*)\.", 1), F.lit(r"\.")) + 1).when(upper, 1).otherwise(2)
    return _by_heading(lines, key, F.coalesce(numbered | upper | short, F.lit(False)), line, level, "Introduction")


def table_sections(rows: DataFrame, columns: list[str], order: list[str], size: int = 100) -> DataFrame:
    """Any table as text sections of `size` rows: header, dashes, and one line of values per row, bars between."""
    line = F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = numbered(rows.select(*{*order, *columns}), [F.col(c) for c in order], "_number")
    placed = rows.select((F.col("_number") - 1).alias("n"), line.alias("line")).withColumn("place", F.floor(F.col("n") / size).cast("int"))
    head = " | ".join(columns) + "\n" + "-" * (sum(map(len, columns)) + 3 * len(columns)) + "\n"
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]), "\n")
    out = placed.groupBy("place").agg(F.min("n").alias("_a"), F.max("n").alias("_b"), body.alias("_body"))
    return out.select("place", F.concat(F.lit("Rows "), F.col("_a") + 1, F.lit("-"), F.col("_b") + 1).alias("title"), F.concat(F.lit(head), F.col("_body")).alias("content"), F.lit(1).alias("level"))


def json_titles(items: DataFrame, item: str = "item") -> DataFrame:
    """A title per JSON object: its title, name, id or key, else its first key, else its number."""
    keys = F.json_object_keys(item)
    first = F.get(keys, F.lit(0))
    title = F.coalesce(
        *[F.when(F.array_contains(keys, k), F.concat(F.lit(f"{k}: "), F.get_json_object(item, f"$.{k}"))) for k in ("title", "name", "id", "key")],
        F.when(F.size(keys) > 0, F.concat(first, F.lit(": "), F.from_json(item, "map<string,string>")[first])),
        F.concat(F.lit("Item "), F.col("place") + 1),
    )
    return items.withColumn("title", title)


def code_sections(docs: DataFrame, key: str = "path", text: str = "content") -> DataFrame:
    """Classes, then functions, of Python, Java and C# sources by their signatures; a file without any is one section."""
    # What opens a class and a function.
    classes = {"py": r"(?m)^class\s+(\w+)", "java": r"\bclass\s+(\w+)", "cs": r"\bclass\s+(\w+)"}
    functions = {"py": r"(?m)^def\s+(\w+)", "java": r"\b(?:public|private|protected)?\s+\w+\s+(\w+)\s*\(", "cs": r"\b(?:public|private|protected)?\s+\w+\s+(\w+)\s*\("}
    ext, kind = extension(F.col(key)), "array<struct<place:int,title:string,content:string,level:int>>"

    def found(label: str, level: int, patterns: dict[str, str]) -> Column:
        out = F.array().cast(kind)
        for e, p in patterns.items():
            pairs = F.arrays_zip(F.regexp_extract_all(text, F.lit(p), F.lit(1)).alias("t"), F.regexp_extract_all(text, F.lit(p), F.lit(0)).alias("c"))
            own = F.transform(pairs, lambda x, i: F.struct((i + 10000 * (level - 1)).alias("place"), F.concat(F.lit(f"{label}: "), x["t"]).alias("title"), x["c"].alias("content"), F.lit(level).alias("level")))
            out = F.when(ext == e, own.cast(kind)).otherwise(out)
        return out

    whole = F.array(F.struct(F.lit(0).alias("place"), F.lit("Full File").alias("title"), F.col(text).alias("content"), F.lit(0).alias("level"))).cast(kind)
    rows = docs.select(key, text, F.concat(found("Class", 1, classes), found("Function", 2, functions)).alias("_s"))
    return rows.select(key, F.explode(F.when(F.size("_s") > 0, F.col("_s")).otherwise(whole)).alias("s")).select(key, "s.*")


def html_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


def html_lang(html: Column) -> Column:
    return F.nullif(F.regexp_extract(html, r"(?i)<html[^>]*\blang=[\"']?([A-Za-z-]+)", 1), F.lit(""))


# The meta tags that count.
META = ("description", "keywords", "author", "og:title", "og:description")


def html_meta(html: Column) -> dict[str, Column]:
    """Contents of a page's meta tags by name or property, og: as og_; null if absent or empty, the last of several."""
    tags = F.regexp_extract_all(html, F.lit(r"(?is)<meta\b[^>]*>"), F.lit(0))

    def of(name: str) -> Column:
        named, filled = rf"(?i)\b(?:name|property)\s*=\s*[\"']?{name}[\"'\s/>]", r"(?i)\bcontent\s*=\s*(?:\"[^\"]+\"|'[^']+')"
        last = F.try_element_at(F.filter(tags, lambda t: t.rlike(named) & t.rlike(filled)), F.lit(-1))
        double, single = (F.regexp_extract(last, rf"(?i)\bcontent\s*=\s*{q}([^{q}]*){q}", 1) for q in ('"', "'"))
        return F.coalesce(F.nullif(double, F.lit("")), F.nullif(single, F.lit("")))

    return {name.replace(":", "_"): of(name) for name in META}


def discovered(files: DataFrame, pattern: str | None = None) -> DataFrame:
    """Visible supported files in order of path."""
    out = files.filter(~F.col("path").rlike(r"(^|/)\.") & loader_of(F.col("path")).isNotNull())
    return (out.filter(F.col("path").rlike(pattern)) if pattern else out).orderBy("path")
