"""Text functions over documents and over texts written out of rows of other given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.queries import query, table

_WORDS = r"regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1)"


@query(rf"SELECT doc_id, len({_WORDS}) AS n_tokens, len(list_distinct({_WORDS})) AS n_distinct FROM documents")
def tokenize_documents(spark, sf_dir):
    words = T.tokenize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(words).cast("long").alias("n_tokens"), F.size(F.array_distinct(words)).cast("long").alias("n_distinct"))


_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


@query(
    rf"""WITH w AS (SELECT conv_id, turn, generate_subscripts(x, 1) AS i, unnest(x) AS w FROM (
           SELECT conv_id, turn, string_split(trim(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' ') AS x FROM conversations)),
         f AS (SELECT conv_id, turn, w, min(i) AS i FROM w WHERE length(w) > 2 AND w NOT IN ({_STOP}) GROUP BY ALL)
         SELECT c.conv_id, c.turn, coalesce((SELECT string_agg(w, ' ' ORDER BY i) FROM f WHERE f.conv_id = c.conv_id AND f.turn = c.turn), '') AS keywords FROM conversations c"""
)
def keyword_extraction(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.keywords(F.col("text")), " ").alias("keywords"))


@query("SELECT doc_id, CASE WHEN length(text) > 2000 THEN substr(text, 1, 2000) || '...' ELSE text END AS embed_text FROM documents")
def embed_truncate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.embed_truncate(F.col("text")).alias("embed_text"))


@query(
    r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]', '', 'g'),
        '[ \t]+', ' ', 'g'), '(?m)^\s+', '', 'g'), '(?m)\s+$', '', 'g'))) AS clean_md5 FROM documents"""
)
def text_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(T.clean_text(F.col("text"))).alias("clean_md5"))


@query("SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS collapsed FROM documents")
def whitespace_collapse(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.collapse(F.col("text")).alias("collapsed"))


@query("SELECT doc_id, " + ", ".join(f"regexp_matches(text, '{p}') AS {n}" for n, p in T.CONTENT_PATTERNS.items()) + " FROM documents")
def content_flags(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in T.content_flags(F.col("text")).items()])


@query("SELECT p_partkey, p_name || ' | ' || p_brand || chr(10) || ' | x | ' || p_size AS cleaned, p_brand AS model FROM part")
def table_clean(spark, sf_dir):
    """Tables written with stray blanks and empty lines, and names of models with tags."""
    text = F.concat(F.lit("  "), "p_name", F.lit("|"), "p_brand", F.lit("  \n\n   \n| x   |"), "p_size")
    return table(spark, sf_dir, "part").select("p_partkey", F.trim(T.clean_table(text)).alias("cleaned"), T.base_model(F.concat("p_brand", F.lit(":"), "p_size", F.lit(":x"))).alias("model"))


def _hits(words):
    return " + ".join(f"contains(lower(text), ' {w} ')::int" for w in words)


@query(
    f"""SELECT doc_id, CASE WHEN length(text) < 10 THEN 'unknown' WHEN es > en THEN 'es' WHEN en > es THEN 'en' ELSE 'unknown' END AS language
        FROM (SELECT doc_id, text, {_hits(T.SPANISH)} AS es, {_hits(T.ENGLISH)} AS en FROM documents)"""
)
def language_guess(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.guess_language(F.col("text")).alias("language"))


@query(
    r"""SELECT doc_id, length(text) AS char_count, len(regexp_extract_all(text, '[.!?]+')) AS sentence_count,
        round(list_sum(list_transform(w, lambda x: length(x))) / greatest(len(w), 1), 6) AS avg_word_length,
        regexp_matches(text, '(^|[^\p{L}\p{N}_])[A-Z]{2,}($|[^\p{L}\p{N}_])') AS has_technical_terms, len(regexp_extract_all(text, '(?s)```.*?```')) AS code_blocks
        FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents)"""
)
def section_enrichment(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in T.section_measures(F.col("text")).items()])


@query(
    """SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n_filled,
       length(text) AS n_chars, length(text) - length(replace(text, ';', '')) AS n_semicolons FROM documents"""
)
def text_metadata(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[c.alias(n) for n, c in T.text_counts(F.col("text")).items()])


@query(
    """SELECT doc_id, md5(concat_ws(':', source, doc_id)) AS point_id, md5(concat_ws(':', source, substr(text, 1, 100))) AS parent_id, sha256(text) AS content_hash FROM documents"""
)
def hash_ids(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", T.point_id(F.col("source"), F.col("doc_id")).alias("point_id"), T.parent_id(F.col("source"), t).alias("parent_id"), F.sha2(t, 256).alias("content_hash"))


_CODE = [
    (1, "a.py", "import os\n# note @\ndef f(x):\n    if x:\n        return 1\n\nclass A:\n    pass"),
    (2, "b.sql", "SELECT * FROM t;\n-- all @\nDELETE FROM t"),
    (3, "c.js", "// x @\nvar a = 1;\nfunction go() { for (;;) { if (a == 1) { while (1) {} } } }"),
    (4, "d.java", "public class D {\n  private int f(int a) { try { switch (a) { case 1: } } catch (E e) {} }\n}"),
    (5, "e.txt", "select x from y\n\tbegin @\nend;"),
    (6, "f", "const a = (b: string) => b"),
    (7, "g.md", "plain words @"),
    (8, "h.plsql", "PROCEDURE p IS\nFUNCTION q\n/* c */"),
]


def _code_rows(spark, sf_dir):
    """A source per part, of eight kinds, with the part's name in it."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey"), "p_name", (F.col("p_partkey") % 8 + 1).alias("id"))
    rows = part.join(F.broadcast(spark.createDataFrame(_CODE, "id long, name string, code string")), "id")  # eight rows
    return rows.select(F.col("p_partkey").alias("id"), "name", F.replace("code", F.lit("@"), F.col("p_name")).alias("code"))


def _values(rows):
    def lit(v):
        return "NULL" if v is None else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows)


_CODE_SQL = f"""WITH t AS (SELECT p_partkey AS id, name, replace(code, '@', p_name) AS code FROM part JOIN (VALUES {_values(_CODE)}) AS v(k, name, code) ON p_partkey % 8 + 1 = k),
 c AS (SELECT *, regexp_extract(lower(name), '\\.([^./]+)$', 1) AS ext, lower(code) AS low FROM t),
 l AS (SELECT *, CASE WHEN ext = 'py' THEN 'python' WHEN ext IN ('js', 'jsx') THEN 'javascript' WHEN ext IN ('ts', 'tsx') THEN 'typescript' WHEN ext = 'java' THEN 'java'
   WHEN ext = 'sql' THEN 'sql' WHEN ext = 'plsql' THEN 'plsql'
   WHEN regexp_matches(code, 'function|const |let |var |=>|import |export ') THEN CASE WHEN regexp_matches(code, 'interface |: string|: number') THEN 'typescript' ELSE 'javascript' END
   WHEN regexp_matches(low, 'def |import |class |self\\.|print\\(') THEN 'python' WHEN regexp_matches(code, 'public class|private |protected |void |static ') THEN 'java'
   WHEN regexp_matches(low, 'select |create |insert |update |delete ') THEN CASE WHEN regexp_matches(low, 'procedure|begin|end;|declare') THEN 'plsql' ELSE 'sql' END
   ELSE 'unknown' END AS language, list_transform(string_split(code, chr(10)), lambda x: trim(x)) AS lines FROM c)"""


@query(_CODE_SQL + " SELECT id, language FROM l")
def code_language(spark, sf_dir):
    rows = _code_rows(spark, sf_dir)
    return rows.select("id", T.code_language(F.col("code"), T.extension(F.col("name"))).alias("language"))


_METRICS_SQL = (
    _CODE_SQL
    + r""" SELECT id, language, len(lines) AS total_lines, len(list_filter(lines, lambda x: x <> '' AND NOT regexp_matches(x, '^(//|#)'))) AS code_lines,
      len(list_filter(lines, lambda x: regexp_matches(x, CASE WHEN language IN ('javascript', 'typescript', 'java') THEN '^(//|/\*|\*)' WHEN language = 'python' THEN '^#'
        WHEN language IN ('sql', 'plsql') THEN '^(--|/\*)' ELSE '^(//|#)' END))) AS comment_lines, len(list_filter(lines, lambda x: x = '')) AS blank_lines,
      CASE language WHEN 'python' THEN len(regexp_extract_all(code, '(?i)\bdef\s+\w+')) WHEN 'javascript' THEN len(regexp_extract_all(code, '(?i)\bfunction\s+\w+'))
        WHEN 'typescript' THEN len(regexp_extract_all(code, '(?i)\bfunction\s+\w+')) WHEN 'java' THEN len(regexp_extract_all(code, '(?i)\b(public|private|protected)\s+\w+\s+\w+\s*\('))
        WHEN 'plsql' THEN len(regexp_extract_all(code, '(?i)\bPROCEDURE\s+\w+|\bFUNCTION\s+\w+')) ELSE 0 END AS functions,
      CASE WHEN language IN ('javascript', 'typescript', 'python', 'java') THEN len(regexp_extract_all(code, '\bclass\s+\w+')) ELSE 0 END AS classes,
      CASE WHEN n < 5 THEN 'low' WHEN n < 15 THEN 'medium' ELSE 'high' END AS complexity
      FROM (SELECT *, len(regexp_extract_all(code, '(?i)\b(if|for|while|switch|case|try|catch)\b')) + len(regexp_extract_all(code, '\b&&\b')) + len(regexp_extract_all(code, '\b\|\|\b')) AS n FROM l)"""
)


@query(_METRICS_SQL)
def code_metrics(spark, sf_dir):
    rows = _code_rows(spark, sf_dir).withColumn("language", T.code_language(F.col("code"), T.extension(F.col("name"))))
    m = T.code_metrics(F.col("code"), F.col("language"))
    return rows.select("id", "language", *[c.alias(n) for n, c in m.items()], T.complexity(F.col("code")).alias("complexity"))


@query(
    f"""WITH m AS ({_METRICS_SQL}), t AS (SELECT p_partkey AS id, replace(code, '@', p_name) AS code FROM part JOIN (VALUES {_values(_CODE)}) AS v(k, name, code) ON p_partkey % 8 + 1 = k)
        SELECT id, language, list_filter([CASE WHEN complexity = 'high' THEN 'Split complex functions into several small ones' END, CASE WHEN comment_lines / greatest(code_lines, 1) < 0.1 THEN 'Explain the code with more comments' END,
          CASE WHEN functions = 0 AND code_lines > 20 THEN 'Group the code into functions' END, CASE WHEN language IN ('javascript', 'typescript') AND contains(code, 'var ') THEN 'Declare variables with const or let instead of var' END,
          CASE WHEN language IN ('javascript', 'typescript') AND (contains(code, '== ') OR contains(code, '!= ')) THEN 'Compare with === and !==' END, CASE WHEN language = 'python' AND contains(code, chr(9)) THEN 'Indent with spaces, not tabs' END,
          CASE WHEN language IN ('sql', 'plsql') AND contains(upper(code), 'SELECT *') THEN 'Name the columns instead of SELECT *' END], lambda x: x IS NOT NULL) AS suggestions FROM m JOIN t USING (id)"""
)
def code_suggestions(spark, sf_dir):
    rows = _code_rows(spark, sf_dir).withColumn("language", T.code_language(F.col("code"), T.extension(F.col("name"))))
    found = T.suggestions(F.col("code"), F.col("language"), T.code_metrics(F.col("code"), F.col("language")), T.complexity(F.col("code")))
    return rows.select("id", "language", found.alias("suggestions"))


_KIND_PATH = "p_name || CASE p_partkey % 7 WHEN 0 THEN '.md' WHEN 1 THEN '.docx' WHEN 2 THEN '.PY' WHEN 3 THEN '.sql' WHEN 4 THEN '' WHEN 5 THEN '.tar.gz' ELSE '.plsql' END"


@query(
    f"""SELECT p_partkey, CASE WHEN e IN ('md', 'markdown') THEN 'markdown' WHEN e IN ('docx', 'doc') THEN 'word' WHEN e IN ('py', 'js', 'ts', 'java') THEN 'code'
        WHEN e IN ('sql', 'plsql') THEN 'sql' ELSE 'default' END AS kind FROM (SELECT p_partkey, regexp_extract(lower({_KIND_PATH}), '\\.([^./]+)$', 1) AS e FROM part)"""
)
def document_type(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.document_type(F.expr(_KIND_PATH)).alias("kind"))


def _allowed_sql() -> str:
    kinds = {0: "markdown", 1: "code", 2: "sql", 3: "default"}
    return " ".join(f"WHEN {n} THEN {list(T.CORE_KEYS + T.TYPE_KEYS[kind])}" for n, kind in kinds.items())


@query(
    f"""WITH e AS (SELECT doc_id, unnest(['section', 'color', 'breadcrumb', 'language', 'doc_author', 'file', 'created_at', 'schema', 'heading_level']) AS k, unnest([coalesce(text, ''), 'red', source, coalesce(lang, ''), 'z', 'f', 't', 's', '2']) AS v FROM documents),
        a AS (SELECT doc_id, k || '=' || substr(v, 1, 500) AS x FROM e WHERE list_contains(CASE doc_id % 4 {_allowed_sql()} END, k)) SELECT doc_id, md5(string_agg(x, ',' ORDER BY x)) AS kept FROM a GROUP BY doc_id"""
)
def metadata_policy(spark, sf_dir):
    """Metadata of documents taken for notes, code, SQL and others: keys that their type has no use for go, long values are cut."""
    docs = table(spark, sf_dir, "documents")
    path = F.concat("doc_id", F.element_at(F.array(*map(F.lit, (".md", ".py", ".sql", ".bin"))), (F.col("doc_id") % 4 + 1).cast("int")))
    text, lang = F.coalesce("text", F.lit("")), F.coalesce("lang", F.lit(""))
    values = {"section": text, "color": F.lit("red"), "breadcrumb": F.col("source"), "language": lang, "doc_author": F.lit("z"), "file": F.lit("f"), "created_at": F.lit("t"), "schema": F.lit("s"), "heading_level": F.lit("2")}
    meta = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    kept = T.truncate_metadata(T.allowed_metadata(meta, T.allowed_keys(T.document_type(path))))
    return docs.select("doc_id", F.md5(F.array_join(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ",")).alias("kept"))


_ANSWER = "CASE turn % 4 WHEN 0 THEN '<think> ' || role || ' </think>' || text WHEN 1 THEN text WHEN 2 THEN 'a<think>x' || chr(10) || text || '</think>b<THINK> z </THINK>c ' || role ELSE '<think>open ' || text END"


@query(
    f"""SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(t, '(?is)<think>(.*?)</think>', 1), lambda x: trim(x)), chr(10)) AS thinking,
        trim(regexp_replace(t, '(?is)<think>.*?</think>', '', 'g')) AS content FROM (SELECT conv_id, turn, {_ANSWER} AS t FROM conversations)"""
)
def think_tags(spark, sf_dir):
    """Messages as answers with one, no, two or an open think tag."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(_ANSWER.replace("chr(10)", "char(10)")).alias("t"))
    return rows.select("conv_id", "turn", *[c.alias(n) for n, c in T.think_parts(F.col("t")).items()])


_TAGGED = "CASE p_partkey % 3 WHEN 0 THEN 'https://x/{{' || p_name || '}}?q={{ ' || p_name || ' }}&k={{key}}' WHEN 1 THEN 'none ' || p_name ELSE '{{a}}{{' || p_brand || '}}{{a}}' END"


@query(
    f"""WITH x AS (SELECT p_partkey, generate_subscripts(g, 1) AS i, trim(unnest(g)) AS tag FROM (SELECT p_partkey, regexp_extract_all({_TAGGED}, '\\{{\\{{([^}}]+)\\}}\\}}', 1) AS g FROM part))
        SELECT p.p_partkey, coalesce((SELECT string_agg(tag, ',' ORDER BY i) FROM (SELECT p_partkey, tag, min(i) AS i FROM x GROUP BY ALL) t WHERE t.p_partkey = p.p_partkey), '') AS tags FROM part p"""
)
def template_tags(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.template_tags(F.expr(_TAGGED)), ",").alias("tags"))


@query("SELECT conv_id, turn, replace(replace('{{role}} said {{text}} at {{level}}', '{{level}}', '0.5'), '{{role}}', 'X') AS filled FROM conversations")
def template_interpolation(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.interpolate(F.lit("{{role}} said {{text}} at {{level}}"), {"level": 0.5, "role": "X"}).alias("filled"))


@query("SELECT o_orderkey, round(o_custkey / 1000 * 0.5 + o_orderkey / 1000 * 0.25, 9) AS cost FROM orders")
def token_cost(spark, sf_dir):
    cost = T.token_cost(F.col("o_custkey"), F.col("o_orderkey"), F.lit(0.5), F.lit(0.25))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(cost, 9).alias("cost"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS iso FROM orders")
def pdf_dates(spark, sf_dir):
    """Dates of orders as PDF files write them: whole, without the prefix, and cut after the month."""
    stamp = F.date_format("o_orderdate", "yyyyMMddHHmmss")
    k = F.col("o_orderkey") % 3
    date = F.when(k == 0, F.concat(F.lit("D:"), stamp, F.lit("Z"))).when(k == 1, stamp).otherwise(F.concat(F.lit("D:"), F.substring(stamp, 1, 6)))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.pdf_date(date).alias("iso"))


@query("SELECT p_partkey, p_name || ' ' || p_type || ' ' || p_brand || ' link [Code Block] ' || p_size || chr(10) || 'end ' || p_name AS plain FROM part")
def markdown_strip(spark, sf_dir):
    text = F.concat(F.lit("**"), "p_name", F.lit("** *"), "p_type", F.lit("* `"), "p_brand", F.lit("` [link](u) ```x\ny``` __"), "p_size", F.lit("__\r\n_end_ "), "p_name")
    return table(spark, sf_dir, "part").select("p_partkey", T.strip_markdown(text).alias("plain"))


_URL = "CASE c_custkey % 5 WHEN 0 THEN 'http://' || lower(c_mktsegment) || '.com/' || c_name WHEN 1 THEN 'https://localhost:80/' || c_custkey WHEN 2 THEN 'ftp://e.org/' || c_custkey WHEN 3 THEN 'HTTPS://127.0.0.1' ELSE 'https://e' || c_custkey || '.org:8080/?q=1' END"


@query(
    f"""SELECT c_custkey, regexp_matches(lower(u), '^https?://') AND h <> '' AND h NOT IN ('localhost', '127.0.0.1') AS ok
        FROM (SELECT c_custkey, u, lower(regexp_extract(u, '^[a-zA-Z]+://([^/:?#]*)', 1)) AS h FROM (SELECT c_custkey, {_URL} AS u FROM customer))"""
)
def url_check(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.url_allowed(F.expr(_URL)).alias("ok"))


_BEFORE, _AFTER = "CASE WHEN p_partkey % 4 > 0 THEN p_brand END", "CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'Brand#' || p_size END"


@query(f"SELECT p_partkey, CASE WHEN a <> b THEN 'embedding model is ' || a || ' and cannot become ' || b END AS refused FROM (SELECT p_partkey, {_BEFORE} AS a, {_AFTER} AS b FROM part)")
def embedding_model_change(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.model_change(F.expr(_BEFORE), F.expr(_AFTER)).alias("refused"))


@query("SELECT c_custkey, CASE WHEN length(c_name) < 100 AND 800 > 500 THEN 500 ELSE 800 END AS max_tokens, substr(c_name, 1, 50) || '...' AS title FROM customer")
def short_answers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", T.max_tokens(F.lit(800), F.col("c_name")).alias("max_tokens"), T.title_of(F.col("c_name")).alias("title"))


@query(
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 100 WHEN 'O' THEN floor(100 * (o_custkey % 7) / 7)::int ELSE 0 END AS percent FROM orders"""
)
def progress_percent(spark, sf_dir):
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "processing").otherwise("pending")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.progress(status, F.col("o_custkey") % 7, F.lit(7)).alias("percent"))
