"""Column functions on metadata: front matter, tags and titles of notes, truncation of nested values, and aliases of parameters."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# How much of a value is kept, and the fields that open a note's full content.
MAX_CHARS, MAX_ITEMS, MAX_ENTRIES = 500, 5, 10
PRIORITY_FIELDS = ("tabla", "id", "name", "title", "code", "identifier", "table")
SECONDARY_FIELDS = ("owner", "tipo", "type", "categoria", "category", "sistema", "system", "status", "version")

# Lines of front matter, as Java's patterns read them: blanks are ASCII, and a line's last character may end it.
_CHAR, _END = r"[^\n\r\x85\u2028\u2029]", r"(?=[\r\x85\u2028\u2029]?\Z)"
_EMPTY = re.compile(rf"\s*(?:#{_CHAR}*)?{_END}", re.ASCII)
_ITEM = re.compile(rf"\s*-(?:\s+|{_END})", re.ASCII)
_KEYED = re.compile(rf"[^:#\s\"'\[{{][^:]*:(?:\s|{_END})", re.ASCII)
_LISTED = re.compile(rf"\[{_CHAR}*\]{_END}")
_QUOTED = re.compile(rf"(?:\"{_CHAR}*\"|'{_CHAR}*'){_END}")
_BREAK = re.compile(r"\r?\n")
_COMMENT = re.compile(rf"\s+#{_CHAR}*{_END}", re.ASCII)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def front_matter_body(text: Column) -> Column:
    return F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---", 1)


def _scalar(value: str) -> str:
    """A scalar without its quotes, or without the comment behind it."""
    return value[1 : len(value) - 1] if _QUOTED.match(value) else _COMMENT.sub("", value).strip(" ")


def _paths_of(body: str) -> dict[str, str]:
    """Paths and scalars of one front matter. Open keys lie on a stack as [indentation, path, items so far]."""
    found: dict[str, str] = {}
    stack: list[list] = []

    def add(path: str, value: str) -> None:
        """One value, or one per item of a list in brackets; none for nothing."""
        if _LISTED.match(value):
            items = [x for x in (x.strip(" ") for x in value[1 : len(value) - 1].split(",")) if x]
            pairs = [(f"{path}[{i}]", _scalar(x)) for i, x in enumerate(items)]
        else:
            pairs = [(path, _scalar(value))] if value else []
        for key, scalar in pairs:
            found.pop(key, None)  # the last of equal paths wins, and stands where it is
            found[key] = scalar

    for line in _BREAK.split(body):
        if _EMPTY.match(line):
            continue
        indent, dash = len(line) - len(line.lstrip(" ")), _ITEM.match(line)
        # an item's key may stand at the item's own indentation; other lines close what is as deep as they
        while stack and (stack[-1][0] > indent or stack[-1][0] == indent and not dash):
            stack.pop()
        text = (line[dash.end() :] if dash else line).strip(" ")
        place = stack[-1][1] if stack else ""
        if dash:
            place += f"[{stack[-1][2] if stack else 0}]"
            if stack:
                stack[-1][2] += 1
        if not _KEYED.match(text):
            if dash:
                add(place, text)
            continue
        key, _, value = text.partition(":")
        path, value = f"{place}.{key.strip(' ')}" if place else key.strip(" "), value.strip(" ")
        # below an item its further keys stand two deeper than its dash
        if dash:
            stack.append([indent + 1, place, 0])
        if value == "":
            stack.append([indent + 2 if dash else indent, path, 0])
        add(path, value)
    return found


def front_matter_paths(text: Column) -> Column:
    """The front matter as a map from paths to scalars: `a.b` for nested keys, `l[0]` for items of a list.

    Its lines are read in order with a stack of open keys by their indentation. Lists may stand at their key's own indentation, be written
    in brackets, or hold maps; comments and empty lines count for nothing, the last of equal paths wins, and a key without anything below it is left out.
    Only the front matter reaches Python, where a line is read once; a fold in SQL copies all that it has found for every line.
    """

    @F.pandas_udf("map<string,string>")
    def paths(bodies: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else _paths_of(b) for b in bodies], dtype=object)

    return paths(front_matter_body(text))


def _last_of_each(pairs: Column) -> Column:
    """Of entries with one key the last."""
    return F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))


def promoted(paths: Column, prefix: str) -> Column:
    """Scalars of the first level under a prefix: `fm_` for a document, `doc_` for its sections."""
    first = F.map_filter(paths, lambda k, v: ~k.rlike(r"[.\[]"))
    return F.transform_keys(first, lambda k, v: F.concat(F.lit(prefix), k))


def inline_tags(text: Column) -> Column:
    """All #tags of a text, in order, wherever they stand (front matter and code as well)."""
    return F.regexp_extract_all(text, F.lit(r"(?U)#([\w-]+)"), F.lit(1))


def document_title(text: Column) -> Column:
    """The first heading of level 1 outside the front matter, without tags; empty if there is none."""
    bare = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")
    return F.trim(F.regexp_replace(F.trim(F.regexp_extract(bare, r"(?m)^\s*#\s+(.+)$", 1)), r"(?U)#[\w-]+", ""))


def full_content(paths: Column, sections: Column) -> Column:
    """A note's text anew: fields of its front matter that name it, further fields in one line, and its sections.

    paths: front_matter_paths; sections: array of structs with title, content and level, in order.
    """

    def label(field: str) -> str:
        return field.replace("_", " ").title()

    def head(m: Column) -> Column:
        first = [F.concat(F.lit(f"**{label(f)}**: "), F.try_element_at(m, F.lit(f))) for f in PRIORITY_FIELDS]
        more = F.nullif(F.concat_ws(" | ", *[F.concat(F.lit(f"{label(f)}: "), F.try_element_at(m, F.lit(f))) for f in SECONDARY_FIELDS]), F.lit(""))
        return _let(F.array_compact(F.array(*first, more)), lambda h: F.when(F.size(h) > 0, F.concat(h, F.array(F.lit("")))).otherwise(h))

    body = F.flatten(F.transform(sections, lambda s: F.array(F.concat(F.repeat(F.lit("#"), F.greatest(s["level"], F.lit(1))), F.lit(" "), s["title"]), s["content"], F.lit(""))))
    return F.regexp_replace(F.array_join(F.concat(_let(paths, head), body), "\n"), r"\A\s+|\s+\z", "")


def _quoted(text: Column) -> Column:
    return _let(F.to_json(F.array(text)), lambda whole: F.substr(whole, F.lit(2), F.length(whole) - 2))


def truncated_json(value: Column, depth: int = 3, chars: int = MAX_CHARS, items: int = MAX_ITEMS, entries: int = MAX_ENTRIES) -> Column:
    """A JSON value with its strings cut to `chars`, its lists to `items` and its objects to `entries`, in their order, at every level.

    What lies deeper than `depth` levels becomes a string, cut as well, so that the plan stays small. Null for what is no JSON.
    A level is read once: its parts carry their text and their typed value down, and nothing is parsed again per part.
    """

    def part(label: Column, raw: Column, typed: Column) -> Column:
        return F.struct(label.alias("label"), raw.alias("raw"), typed.alias("typed"), F.schema_of_variant(typed).alias("kind"))

    def child(p: Column, left: int) -> Column:
        nested = p["kind"].startswith("OBJECT") | p["kind"].startswith("ARRAY")
        below = cut(p, left - 1) if left > 0 else _quoted(F.substring(p["raw"], 1, chars))
        return F.when(p["kind"] == "STRING", _quoted(F.substring(p["raw"], 1, chars))).when(nested, below).otherwise(F.coalesce(p["raw"], F.lit("null")))

    def cut(p: Column, left: int) -> Column:
        texts = F.slice(F.map_entries(F.from_json(p["raw"], "map<string,string>")), 1, entries)
        of_object = _let(p["typed"].try_cast("map<string,variant>"), lambda types: F.transform(texts, lambda e: part(F.concat(_quoted(e["key"]), F.lit(":")), e["value"], F.try_element_at(types, e["key"]))))
        values = F.slice(F.from_json(p["raw"], "array<string>"), 1, items)
        of_list = _let(p["typed"].try_cast("array<variant>"), lambda types: F.transform(values, lambda v, i: part(F.lit(""), v, F.get(types, i))))
        is_object = p["kind"].startswith("OBJECT")
        inside = F.array_join(F.transform(F.when(is_object, of_object).otherwise(of_list), lambda c: F.concat(c["label"], child(c, left))), ",")
        return F.concat(F.when(is_object, F.lit("{")).otherwise(F.lit("[")), inside, F.when(is_object, F.lit("}")).otherwise(F.lit("]")))

    def whole(p: Column) -> Column:
        nested = p["kind"].startswith("OBJECT") | p["kind"].startswith("ARRAY")
        text = _quoted(F.substring(F.from_json(F.concat(F.lit("["), p["raw"], F.lit("]")), "array<string>")[0], 1, chars))
        plain = F.when(p["kind"] == "STRING", text).otherwise(F.trim(p["raw"]))
        return F.when(p["typed"].isNotNull(), F.coalesce(F.when(nested, cut(p, depth)), plain))

    return _let(value, lambda raw: _let(F.try_parse_json(raw), lambda typed: _let(part(F.lit(""), raw, typed), whole)))


def aliases(config: Column) -> Column:
    """Keys of a configuration (JSON) whose value is exactly one {{tag}}, at any depth: an array of (key, tag)."""
    pattern = F.lit(r'"([^"\\]+)"\s*:\s*"\s*\{\{([^}"]+)\}\}\s*"')
    return F.arrays_zip(F.regexp_extract_all(config, pattern, F.lit(1)).alias("key"), F.transform(F.regexp_extract_all(config, pattern, F.lit(2)), lambda t: F.trim(t)).alias("tag"))


def with_aliases(config: Column, given: Column) -> Column:
    """Given parameters (a map), and those that follow from them: a key's value for its only tag, or a tag's value for its key.

    What is given stays; of several that would name the same parameter the last wins.
    """
    known = lambda k: F.array_contains(F.map_keys(given), k)
    pairs = F.transform(
        aliases(config),
        lambda a: F.when(known(a["key"]) & ~known(a["tag"]), F.struct(a["tag"].alias("key"), F.try_element_at(given, a["key"]).alias("value"))).when(
            known(a["tag"]) & ~known(a["key"]), F.struct(a["key"].alias("key"), F.try_element_at(given, a["tag"]).alias("value"))
        ),
    )
    return _let(F.array_compact(pairs), lambda new: F.when(F.size(new) > 0, F.map_concat(given, F.map_from_entries(_last_of_each(new)))).otherwise(given))


# Headers and rows of tables that name an author, headers of a history of versions, and names that are none.
AUTHOR_HEADERS = ("autor", "author")
PREPARED = ("preparación", "preparacion")
HISTORY_HEADERS = (("versión", "version"), ("fecha",), ("resumen de los cambios", "resumen", "summary"), ("autor",))
NO_AUTHORS = ("autor", "author", "unknown", "desconocido", "no especificado", "sin autor", "sin nombre", "n/a", "user", "usuario", "default", "plantilla", "template")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def is_history(headers: Column, groups: Sequence[Sequence[str]] = HISTORY_HEADERS) -> Column:
    """True if a table's headers share one with each group: a history of versions."""
    low = F.transform(headers, lambda h: F.lower(collapsed(h)))
    out = F.lit(True)
    for group in groups:
        out = out & F.arrays_overlap(low, F.array(*map(F.lit, group)))
    return out


def known_author(name: Column) -> Column:
    """An author's name, or empty if it is a placeholder."""
    return F.when(F.lower(F.trim(name)).isin(*NO_AUTHORS), "").otherwise(F.trim(name))
