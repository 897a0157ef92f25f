"""Contexts of answers: the files a question means, the hits kept for them, their layout, and whose collection to search."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.operators.retrieval import cosine, vector_search

# How a question points at a document, what stands before a quoted file name, what such a name sheds, and
# the extensions that tell a file name otherwise, in the order in which they are tried.
POINTING = r"\b(este|el)\s+(documento|archivo|adjunto|fichero|pdf|word|excel|csv|html|ppt|pptx|docx|xlsx|txt|md|markdown|imagen|foto|video|audio)"
BEFORE_NAME = ("documento", "archivo", "fichero", "el documento", "el archivo", "el fichero", "este documento", "este archivo", "este fichero", "sobre", "del documento", "del archivo")
SHED = r"^\s*(el|este|un|una|los|las|el\s+documento|el\s+archivo|el\s+fichero|este\s+documento|este\s+archivo|este\s+fichero|sobre|del\s+documento|del\s+archivo)\s+"
EXTENSIONS = ("docx", "doc", "pdf", "txt", "md", "xlsx", "csv", "pptx", "json", "py", "js", "ts", "java", "sql")


def points_at_document(question: Column) -> Column:
    """True if the question speaks of `this` or `the` document without naming it."""
    return question.rlike(f"(?iU){POINTING}")


def mentioned_file(question: Column) -> Column:
    """The file a question names: in double quotes after a word for documents, else the last word of a name with a known
    extension and the quote behind it; null if none."""
    found = []
    for words in BEFORE_NAME:
        pattern = "(?iU)" + words.replace(" ", r"\s+") + r"""\s+"([^"']+)(["'])"""
        name = F.trim(F.regexp_extract(question, pattern, 1))
        found.append(F.when(F.regexp_extract(question, pattern, 2) == '"', F.regexp_replace(name, f"(?iU){SHED}", "")))
    for ext in EXTENSIONS:
        found.append(F.nullif(F.trim(F.regexp_extract(question, rf"""(?iU)([^"'. ,;:\n\t]*\.{ext}\s*["'])""", 1)), F.lit("")))
    return F.coalesce(*found)


def kept_for_files(hits: DataFrame, attached: Sequence[object] = (), mentioned: str | None = None, id_col: str = "file_id", name_col: str = "file") -> DataFrame:
    """Hits of the attached files if there are two or more, else those whose file name holds the mentioned one, else all."""
    if len(attached) > 1:
        return hits.filter(F.col(id_col).isin(*attached))
    if mentioned:
        return hits.filter(F.contains(F.lower(name_col), F.lower(F.lit(mentioned))))
    return hits


def laid_out(hits: DataFrame, query: str, file: str = "file", section: str = "section", content: str = "content", pos: str = "pos") -> DataFrame:
    """query, context: hits grouped by file in order of first appearance, fragments numbered inside each file.

    hits are the k best of each query, so that a query's text is one value. A missing file counts as `Unknown File`.
    """
    rows = hits.withColumn("_file", F.coalesce(F.col(file), F.lit("Unknown File")))
    n = F.row_number().over(W.partitionBy(query, "_file").orderBy(pos))
    part = F.concat(F.lit("**Fragment "), n.cast("string"), F.lit(" - "), F.coalesce(section, F.lit("")), F.lit("**\n"), F.coalesce(content, F.lit("")), F.lit("\n\n"))
    rows = rows.select(query, "_file", F.col(pos).alias("_pos"), part.alias("_part"))

    def joined(column: Column) -> Column:
        return F.array_join(F.transform(F.array_sort(column), lambda x: x["_part"]), "")

    files = rows.groupBy(query, "_file").agg(F.min("_pos").alias("_pos"), F.collect_list(F.struct("_pos", "_part")).alias("_parts"))
    files = files.select(query, "_pos", F.concat(F.lit("### File: "), "_file", F.lit("\n\n"), joined(F.col("_parts")), F.lit("---\n\n")).alias("_part"))
    whole = files.groupBy(query).agg(F.collect_list(F.struct("_pos", "_part")).alias("_files"))
    return whole.select(query, F.concat(F.lit("## Relevant Documentation\n\n"), joined(F.col("_files"))).alias("context"))


#: What surrounds a context by the mode of answering; {} is the context.
WRAPPERS = {
    "strict": "## Verified context\nAnswer from this text alone and name its files; say so if it does not hold the answer.\n\n{}",
    "creative": "## Context\nStart from this text; mark what goes beyond it as a guess.\n\n{}",
    "default": "## Context\n{}",
}


def wrapped(context: Column, mode: Column) -> Column:
    """The context inside the words of its mode; unknown modes use the default ones."""
    out = F.replace(F.lit(WRAPPERS["default"]), F.lit("{}"), context)
    for name, words in WRAPPERS.items():
        out = F.when(mode == name, F.replace(F.lit(words), F.lit("{}"), context)).otherwise(out)
    return out


def confidence(sources: Column) -> Column:
    """0.8 for an answer with any source, else 0.3."""
    return F.when(F.coalesce(F.size(sources), F.lit(0)) > 0, 0.8).otherwise(0.3)


def collection_name(project: Column, conversation: Column, custom: Column, default: str = "documents") -> Column:
    """A file's collection: its project's, else the one its conversation is set to or the conversation's own, else the default."""
    own = F.coalesce(F.nullif(custom, F.lit("")), F.concat(F.lit("chat_"), conversation.cast("string")))
    return F.when(project.isNotNull(), F.concat(F.lit("project_"), project.cast("string"))).when(conversation.isNotNull(), own).otherwise(F.lit(default))


def default_collections(conversations: DataFrame, files: DataFrame, conv: str = "conv_id", project: str = "project_id", processed: str = "processed") -> DataFrame:
    """conv, place, collection: the project's collection, then the conversation's own if any of its files is processed."""
    of_project = conversations.filter(F.col(project).isNotNull()).select(conv, F.lit(0).alias("place"), F.concat(F.lit("project_"), F.col(project).cast("string")).alias("collection"))
    ready = conversations.join(files.filter(F.col(processed)).select(conv), conv, "left_semi")
    return of_project.unionByName(ready.select(conv, F.lit(1).alias("place"), F.concat(F.lit("chat_"), F.col(conv).cast("string")).alias("collection")))


def direct_content(extracted: Column, raw: Column, limit: int = 2000) -> Column:
    """What stands in for hits when there are none: the extracted text, else the opening of the file."""
    return F.coalesce(F.nullif(extracted, F.lit("")), F.substring(raw, 1, limit))


def search_memory(points: DataFrame, asked: DataFrame, k: int = 5, threshold: float = 0.3, conv: str = "conv_id", id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Per conversation the k messages most like its question: conv, id, score, rank; one join on the conversation.

    asked: conv and `question`, a vector. The cut keeps k rows a conversation; Spark cuts inside each task first.
    """
    both = points.select(conv, id_col, vector_col).join(asked.select(conv, "question"), conv)
    hits = both.select(conv, id_col, F.round(cosine(F.col(vector_col), F.col("question")), 6).alias("score")).filter(F.col("score") >= threshold)
    rank = F.row_number().over(W.partitionBy(conv).orderBy(F.desc("score"), id_col))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def search_one_collection(points: DataFrame, collection: object, query: Sequence[float], k: int = 5, threshold: float = 0.5, collection_col: str = "collection", **names: str) -> DataFrame:
    """The k points of one collection most like query; k must be from 1 to 20."""
    if not 1 <= k <= 20:
        raise ValueError("k must be from 1 to 20")
    return vector_search(points, query, k, threshold, {collection_col: collection}, **names)


def first_known(rows: DataFrame, sources: Sequence[tuple[DataFrame, str]], value: str, default: Column | None = None) -> DataFrame:
    """rows with `value` from the first source that knows it: one left join per (source, key), then the default."""
    names = []
    for i, (source, key) in enumerate(sources):
        names.append(f"_value_{i}")
        rows = rows.join(source.groupBy(key).agg(F.max(value).alias(names[-1])), key, "left")
    return rows.withColumn(value, F.coalesce(*names, *([] if default is None else [default]))).drop(*names)


def merged_properties(definitions: DataFrame, kind: str, name: str, order: Sequence[str]) -> DataFrame:
    """Of several definitions of a property of one kind the first stays."""
    place = F.row_number().over(W.partitionBy(kind, name).orderBy(*order))
    return definitions.withColumn("_rn", place).filter("_rn = 1").drop("_rn")


def tools_of_mode(physical: DataFrame, custom: DataFrame, mode: str, kind: str = "kind", name: str = "name") -> DataFrame:
    """In manual mode all built-in tools; otherwise kinds with configured instances are replaced by these."""
    built = physical.select(kind, name, F.lit(False).alias("configured"))
    if mode == "manual":
        return built
    mine = custom.select(kind, name, F.lit(True).alias("configured"))
    return built.join(mine.select(kind).distinct(), kind, "left_anti").unionByName(mine)


# Parts of names that tell a model's type, in order, and what it can do.
MODEL_NAMES = (
    ("embedding", ("embed", "embedding", "bge", "e5", "gte", "instructor", "mxbai")),
    ("vision", ("vision", "llava", "bakllava", "minicpm-v")),
    ("multimodal", ("multimodal", "llava", "cogvlm", "fuyu")),
)
REASONING_NAMES = ("deepseek-r1", "r1", "reasoner", "cot", "qwq")
THINKING_NAMES = ("gemma3", "qwen3", "qwen2.5", "thinking")
TOOL_NAMES = ("llama3", "mistral", "mixtral", "gemma2", "qwen", "command")


def _any_part(low: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(low, F.lit(p)) for p in parts])


def model_traits(model: Column) -> dict[str, Column]:
    """model_type, supports_tools and supports_thinking by name; a chat model whose name speaks of reasoning is of that type."""
    low, kind = F.lower(model), inferred_type(model)
    chat = kind == "chat"
    reasons = chat & _any_part(low, REASONING_NAMES)
    return {
        "model_type": F.when(reasons, "reasoning").otherwise(kind),
        "supports_tools": chat & _any_part(low, TOOL_NAMES),
        "supports_thinking": reasons | chat & _any_part(low, THINKING_NAMES),
    }


def inferred_type(model: Column, names: Sequence[tuple[str, Sequence[str]]] = MODEL_NAMES, default: str = "chat") -> Column:
    """The type of the first entry of which any part occurs in the lower-cased model name."""
    low = F.lower(model)
    tests = [(kind, _any_part(low, parts)) for kind, parts in names]
    out = F.lit(default)
    for kind, test in reversed(tests):
        out = F.when(test, kind).otherwise(out)
    return out


def imported_name(name: Column, taken: Column) -> Column:
    """name, with a suffix if it is taken."""
    return F.when(taken, F.concat(name, F.lit(" (Imported)"))).otherwise(name)


def exported(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One JSON text per row."""
    return rows.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("template"))


def imported(texts: DataFrame, schema: str, taken: DataFrame, name: str = "name") -> DataFrame:
    """Rows of exported texts; those whose name is taken get a suffix."""
    rows = texts.select(F.from_json("template", schema).alias("t")).select("t.*")
    known = taken.select(name).distinct().withColumn("_taken", F.lit(True))
    found = rows.join(known, name, "left")
    return found.withColumn(name, imported_name(F.col(name), F.coalesce("_taken", F.lit(False)))).drop("_taken")
