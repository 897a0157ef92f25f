"""Ingestion queries: sections, chunks, embedding texts and incremental sync."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.operators import chunking as K
from quillspark.operators import ingestion as N
from quillspark.operators import sync as S
from quillspark.operators.stages import shared_folder
from quillspark.queries import query, table
from quillspark.sources import formats as Y
from quillspark.sources import parsers as P
from quillspark.sources import sections as X
from quillspark.streaming.ingest import windowed_counts


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query(
    """WITH l AS (SELECT doc_id, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS p FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS a FROM documents)),
       b AS (SELECT doc_id, i, regexp_replace(regexp_replace(p, '^\\s+', ''), '\\s+$', '') AS body FROM l),
       s AS (SELECT *, string_split(body, chr(10))[1] AS f FROM b WHERE body <> '')
       SELECT doc_id, i AS place, CASE WHEN contains(body, chr(10)) AND length(f) < 100 THEN f ELSE 'Paragraph ' || (i + 1) END AS title,
       md5(CASE WHEN contains(body, chr(10)) AND length(f) < 100 THEN regexp_replace(substr(body, length(f) + 2), '^\\s+', '') ELSE body END) AS content_md5 FROM s"""
)
def text_sections(spark, sf_dir):
    return X.text_sections(_docs(spark, sf_dir), "doc_id", "text").select("doc_id", "place", "title", F.md5("content").alias("content_md5"))


@query(
    """WITH l AS (SELECT doc_id, generate_subscripts(a, 1) AS n, unnest(a) AS line FROM (SELECT doc_id, string_split(replace(text, '. ', chr(10) || '# '), chr(10)) AS a FROM documents)),
       h AS (SELECT *, regexp_matches(line, '^\\s*(#{1,6})\\s+(.+)$') AS h FROM l), p AS (SELECT *, sum(h::int) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS place FROM h),
       g AS (SELECT doc_id, place, regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT h), ''), '^\\s+', ''), '\\s+$', '') AS content FROM p GROUP BY ALL)
       SELECT doc_id, count(*) AS n_sections, sum(length(content)) AS chars FROM g WHERE content <> '' GROUP BY doc_id"""
)
def line_sections(spark, sf_dir):
    """Documents as markdown: every sentence after the first becomes a heading line, so that the rule has work."""
    docs = _docs(spark, sf_dir).withColumn("text", F.replace("text", F.lit(". "), F.lit("\n# ")))
    found = X.markdown_sections(docs, "doc_id", "text").filter("title <> 'General'")
    return found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sections"), F.sum(F.length("content")).alias("chars"))


_NOTE = """CASE p_partkey % 3 WHEN 0 THEN '---' || chr(10) || 'title: x' || chr(10) || '---' || chr(10) || 'intro ' || p_name || chr(10) || '# One ' || p_brand || chr(10) || 'body `#t`' || chr(10) || chr(10) || '## put ' || p_name || chr(10) || 'Contexto: main `/api/{id}` ' || p_type || chr(10) || '### empty' || chr(10)
 WHEN 1 THEN 'plain ' || p_name ELSE '' END"""


def _notes(spark, sf_dir):
    """A note per part: with front matter and headings, plain, or empty."""
    return table(spark, sf_dir, "part").select("p_partkey", F.expr(_NOTE.replace("chr(10)", "char(10)")).alias("content"))


@query(
    rf"""WITH l AS (SELECT p_partkey, generate_subscripts(a, 1) AS n, unnest(a) AS line FROM (SELECT p_partkey, string_split(regexp_replace({_NOTE}, '(?s)\A---\n.*?\n---\n?', ''), chr(10)) AS a FROM part)),
        h AS (SELECT *, regexp_matches(line, '^\s*(#{{1,6}})\s+(.+)$') AS h FROM l), p AS (SELECT *, sum(h::int) OVER (PARTITION BY p_partkey ORDER BY n ROWS UNBOUNDED PRECEDING) AS place FROM h),
        g AS (SELECT p_partkey, place::int AS place, max(line) FILTER (h) AS head, regexp_replace(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT h), ''), '^\s+', ''), '\s+$', '') AS content FROM p GROUP BY ALL),
        t AS (SELECT *, max(place) OVER (PARTITION BY p_partkey) AS most FROM g WHERE content <> '')
        SELECT p_partkey, place, CASE WHEN most = 0 THEN 'Document Content' WHEN head IS NULL THEN 'Introduction' ELSE trim(regexp_extract(head, '^\s*(#{{1,6}})\s+(.+)$', 2)) END AS title, content, coalesce(length(regexp_extract(head, '^\s*(#{{1,6}})', 1)), 0)::int AS level FROM t
        UNION ALL SELECT p_partkey, 0, 'General', {_NOTE}, 1 FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM t)"""
)
def markdown_sections(spark, sf_dir):
    return X.markdown_sections(_notes(spark, sf_dir), "p_partkey")


@query("SELECT p_partkey, 'PUT' AS http_method, '/api/{id}' AS endpoint, 'main' AS context FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, NULL, NULL, NULL FROM part WHERE p_partkey % 3 = 0")
def section_api(spark, sf_dir):
    found = X.markdown_sections(_notes(spark, sf_dir), "p_partkey").filter("level > 0 and title <> 'General'")
    return found.select("p_partkey", *[c.alias(n) for n, c in X.section_api(F.col("title"), F.col("content")).items()])


@query(
    """WITH r AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS n, concat_ws(' | ', c_custkey, c_name, c_mktsegment) AS line FROM customer)
       SELECT (n // 100)::int AS place, 'Rows ' || (min(n) + 1) || '-' || (max(n) + 1) AS title,
       md5('c_custkey | c_name | c_mktsegment' || chr(10) || repeat('-', 36) || chr(10) || string_agg(line, chr(10) ORDER BY n)) AS content_md5 FROM r GROUP BY 1"""
)
def csv_sections(spark, sf_dir):
    out = X.table_sections(table(spark, sf_dir, "customer"), ["c_custkey", "c_name", "c_mktsegment"], ["c_custkey"])
    return out.select("place", "title", F.md5("content").alias("content_md5"))


@query(r"""SELECT page_id, nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)), '') AS title, nullif(regexp_extract(html, '(?i)<html[^>]*\blang=["'']?([A-Za-z-]+)', 1), '') AS lang FROM pages""")
def html_title_lang(spark, sf_dir):
    h = F.col("html")
    return table(spark, sf_dir, "pages").select("page_id", X.html_title(h).alias("title"), X.html_lang(h).alias("lang"))


def _html_sql() -> str:
    """The rule of html_sections, step by step."""
    x = r"coalesce(nullif(regexp_extract(html, '(?is)<main\b.*</main>'), ''), nullif(regexp_extract(html, '(?is)<article\b.*</article>'), ''), nullif(regexp_extract(html, '(?is)<body\b.*'), ''), html)"
    steps = [("(?s)<!--.*?-->", "''"), *[(rf"(?is)<{t}\b.*?</{t}\s*>", "''") for t in ("script", "style", "nav", "footer", "aside")], (r"[\s\x00-\x1f]+", "' '")]
    for k in range(1, 7):
        steps += [(rf"(?i)<h{k}\b[^>]*>", f"chr(10) || chr(1) || '{k}'"), (rf"(?i)</h{k}\s*>", "chr(10)")]
    steps += [(r"(?i)</?(?:p|div|li|td|th|tr|br|ul|ol|table|section|article|main|body|html|head|header|title)\b[^>]*>", "chr(10)"), ("<[A-Za-z/!][^>]*>", "''")]
    for pattern, new in steps:
        x = f"regexp_replace({x}, '{pattern}', {new}, 'g')"
    for name, char in (("&nbsp;", "' '"), ("&lt;", "'<'"), ("&gt;", "'>'"), ("&quot;", "chr(34)"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        x = f"replace({x}, '{name}', {char})"
    bare = r"regexp_replace(regexp_replace({0}, '^[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ''), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+$', '')"
    return rf"""WITH a AS (SELECT page_id, string_split({x}, chr(10)) AS a FROM pages), l AS (SELECT page_id, generate_subscripts(a, 1) AS n, {bare.format("unnest(a)")} AS line FROM a),
        k AS (SELECT *, starts_with(line, chr(1)) AS h FROM l WHERE line <> '' AND NOT regexp_matches(line, '^\x01[1-6]$')),
        p AS (SELECT *, sum(h::int) OVER (PARTITION BY page_id ORDER BY n ROWS UNBOUNDED PRECEDING)::int AS place FROM k),
        g AS (SELECT page_id, place, max(line) FILTER (h) AS head, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT h), '') AS content FROM p GROUP BY ALL)
        SELECT page_id, place, CASE WHEN head IS NULL THEN 'Introduction' ELSE {bare.format("substr(head, 3)")} END AS title, md5(content) AS content_md5, coalesce(substr(head, 2, 1)::int, 0) AS level FROM g WHERE content <> ''"""


_Q = "' || chr(39) || '"
_HEAD = f"""'<meta name="description" content="page ' || page_id || '"><META content={_Q}a, b{_Q} property=keywords ><meta property="og:title" content="' || url || '"/><meta name="author"><meta name="description" content="last ' || page_id || '">'"""


def _meta_sql() -> str:
    """The last tag of each name that has a content, in either kind of quotes."""
    part = rf"""nullif(coalesce(nullif(regexp_extract(t, '(?i)\bcontent\s*=\s*"([^"]*)"', 1), ''), regexp_extract(t, '(?i)\bcontent\s*=\s*{_Q}([^{_Q}]*){_Q}', 1)), '')"""
    pick = rf"""(SELECT {part} FROM (SELECT list_filter(tags, lambda x: regexp_matches(x, '(?i)\b(?:name|property)\s*=\s*["{_Q}]?NAME["{_Q}\s/>]') AND regexp_matches(x, '(?i)\bcontent\s*=\s*(?:"[^"]+"|{_Q}[^{_Q}]+{_Q})'))[-1] AS t))"""
    columns = ", ".join(f"{pick.replace('NAME', n)} AS {n.replace(':', '_')}" for n in X.META)
    return rf"WITH p AS (SELECT page_id, regexp_extract_all(h, '(?is)<meta\b[^>]*>') AS tags FROM (SELECT page_id, {_HEAD} || html AS h FROM pages)) SELECT page_id, {columns} FROM p"


@query(_meta_sql())
def html_meta(spark, sf_dir):
    """Pages with some more meta tags in front: repeated, without content, in either order of attributes and quotes."""
    rows = table(spark, sf_dir, "pages").select("page_id", F.expr(f"{_HEAD} || html".replace("chr(", "char(")).alias("h"))
    return rows.select("page_id", *[c.alias(n) for n, c in X.html_meta(F.col("h")).items()])


@query(_html_sql())
def html_sections(spark, sf_dir):
    found = Y.html_sections(table(spark, sf_dir, "pages"), "page_id", "html")
    return found.select("page_id", "place", "title", F.md5("content").alias("content_md5"), "level")


_SCRIPTS = ["'class A' || p_partkey || ':' || chr(10) || '    def m(self):' || chr(10) || 'def f' || p_size || '():' || chr(10) || '    pass' || chr(10)", "'class B' || p_partkey || ' { public int go' || p_size || '(int a) { } }'", "'public class C' || p_partkey || ' { private void Run' || p_size || '() { } }'", "'function x' || p_partkey || '() {}'"]
_SOURCE = f"CASE p_partkey % 4 WHEN 0 THEN {_SCRIPTS[0]} WHEN 1 THEN {_SCRIPTS[1]} WHEN 2 THEN {_SCRIPTS[2]} ELSE {_SCRIPTS[3]} END"
_SOURCE_PATH = "'src/' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.py' WHEN 1 THEN '.java' WHEN 2 THEN '.cs' ELSE '.js' END"


@query(
    rf"""WITH c AS (SELECT {_SOURCE_PATH} AS path, p_partkey % 4 AS k, {_SOURCE} AS content FROM part),
        f AS (SELECT path, 'Class: ' || unnest(regexp_extract_all(content, CASE k WHEN 0 THEN '(?m)^class\s+(\w+)' ELSE '\bclass\s+(\w+)' END, 1)) AS title, 1 AS level FROM c WHERE k < 3
          UNION ALL SELECT path, 'Function: ' || unnest(CASE k WHEN 0 THEN regexp_extract_all(content, '(?m)^def\s+(\w+)', 1) ELSE regexp_extract_all(content, '\b(?:public|private|protected)?\s+\w+\s+(\w+)\s*\(', 1) END), 2 FROM c WHERE k < 3)
        SELECT * FROM f UNION ALL SELECT path, 'Full File', 0 FROM c WHERE path NOT IN (SELECT path FROM f)"""
)
def code_sections(spark, sf_dir):
    """Sources written out of parts, in Python, Java, C# and JavaScript."""
    part = table(spark, sf_dir, "part").select(F.expr(_SOURCE_PATH).alias("path"), F.expr(_SOURCE.replace("chr(10)", "char(10)")).alias("content"))
    return X.code_sections(part).select("path", "title", "level")


_FIVE = ["0 AS place, 'SELECT ' || p_size AS title, 'SELECT ' || p_size || ';' AS content, 2 AS level", "1, 'PACKAGE_BODY: pkg.b' || p_partkey, 'CREATE or REPLACE PACKAGE  BODY pkg.b' || p_partkey || ' AS x;', 1", "2, 'UPDATE t SET a = ' || p_size, 'UPDATE t SET a = ' || p_size || ';', 2", "3, '-- ' || p_name, '-- ' || p_name || ';', 2", "4, 'TABLE: t' || p_partkey, 'create table t' || p_partkey || ' (a int, b int);', 1"]


@query(" UNION ALL ".join(f"SELECT p_partkey, {x} FROM part" for x in _FIVE))
def sql_sections(spark, sf_dir):
    """A script per part: a statement, blocks, a comment and lower case."""
    name = F.col("p_partkey").cast("string")
    script = F.concat(F.lit("SELECT "), "p_size", F.lit(";\nCREATE or REPLACE PACKAGE  BODY pkg.b"), name, F.lit(" AS x;\nUPDATE t SET a = "), "p_size", F.lit("; -- "), "p_name", F.lit("\ncreate table t"), name, F.lit(" (a int, b int);\n"))
    return Y.sql_sections(table(spark, sf_dir, "part").select("p_partkey", script.alias("content")), "p_partkey")


@query(
    """SELECT event_id, 0 AS place, CASE event_id % 3 WHEN 0 THEN 'k' ELSE 'k: ' || (props->>'$.k') END AS title, CASE event_id % 3 WHEN 0 THEN props->>'$.k' ELSE 'k: ' || (props->>'$.k') END AS content, 1 AS level FROM events
       UNION ALL SELECT event_id, 1, CASE event_id % 3 WHEN 1 THEN 'id: n' ELSE 'k: ' || (props->>'$.k') END, CASE event_id % 3 WHEN 1 THEN 'x:' || chr(10) || '  k: ' || (props->>'$.k') || chr(10) || 'id: n' ELSE 'k: ' || (props->>'$.k') END, 1 FROM events WHERE event_id % 3 > 0"""
)
def json_sections(spark, sf_dir):
    """Properties of events as one object, as a list with an object around them, and as JSON lines."""
    p = F.col("props")
    content = F.when(F.col("event_id") % 3 == 0, p).when(F.col("event_id") % 3 == 1, F.concat(F.lit("["), p, F.lit(', {"x": '), p, F.lit(', "id": "n"}]'))).otherwise(F.concat(p, F.lit("\n"), p))
    return Y.json_sections(table(spark, sf_dir, "events").select("event_id", content.alias("content")), "event_id")


@query("SELECT event_id, 'k: ' || (props->>'$.k') AS title FROM events")
def json_titles(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("item"), F.lit(0).alias("place"))
    return X.json_titles(rows).select("event_id", "title")


_ENDS = "CASE p_partkey % 8 WHEN 0 THEN '.MD' WHEN 1 THEN '.docx' WHEN 2 THEN '.jsonl' WHEN 3 THEN '.pks' WHEN 4 THEN '.go' WHEN 5 THEN '.bin' WHEN 6 THEN '.tar.gz' ELSE '' END"


@query(f"SELECT p_partkey, p_name || {_ENDS} AS path, CASE p_partkey % 8 WHEN 0 THEN 'markdown' WHEN 1 THEN 'word' WHEN 2 THEN 'json' WHEN 3 THEN 'sql' WHEN 4 THEN 'code' END AS loader FROM part")
def loader_dispatch(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(f"p_name || {_ENDS}").alias("path"))
    return rows.withColumn("loader", X.loader_of(F.col("path")))


_TREE = "CASE p_partkey % 6 WHEN 0 THEN 'a/c' || p_partkey || '.txt' WHEN 1 THEN 'a/.git/x' || p_partkey || '.md' WHEN 2 THEN '.h' || p_partkey || '.md' WHEN 3 THEN 'a/b' || p_partkey || '.md' WHEN 4 THEN 'a/d' || p_partkey || '.bin' ELSE 'z' || p_partkey || '.md' END"


@query(rf"SELECT path FROM (SELECT {_TREE} AS path FROM part) WHERE starts_with(path, 'a/') AND NOT regexp_matches(path, '(^|/)\.') AND regexp_matches(path, '\.(txt|md)$')")
def document_discovery(spark, sf_dir):
    return X.discovered(table(spark, sf_dir, "part").select(F.expr(_TREE).alias("path")), "^a/")


_PAGE = "'1. Start ' || p_brand || chr(10) || 'body one ' || p_name || ' and so on.' || chr(10) || 'ALL CAPS LINE' || chr(10) || 'more text here, long enough' || chr(10) || '1.2. Deeper ' || p_size || chr(10) || 'end'"


@query(
    rf"""WITH l AS (SELECT p_partkey, generate_subscripts(a, 1) AS n, trim(unnest(a)) AS line FROM (SELECT p_partkey, string_split({_PAGE}, chr(10)) AS a FROM part)),
        x AS (SELECT *, lead(line) OVER (PARTITION BY p_partkey ORDER BY n) AS nxt FROM l),
        k AS (SELECT *, regexp_matches(line, '^\d+(\.\d+)*\.\s+.+$') AS num, line = upper(line) AND lower(line) <> line AND len(regexp_split_to_array(line, '\s+')) >= 2 AND length(line) < 100 AS up,
              length(line) < 80 AND line <> '' AND NOT regexp_matches(line, '[.,;:]$') AND length(nxt) > 1.5 * length(line) AND NOT regexp_matches(line, '^[-•*]') AND regexp_matches(line, '^\p{{Lu}}') AS short FROM x),
        p AS (SELECT *, coalesce(num OR up OR short, false) AS h, sum(coalesce(num OR up OR short, false)::int) OVER (PARTITION BY p_partkey ORDER BY n ROWS UNBOUNDED PRECEDING)::int AS place FROM k)
        SELECT p_partkey, place, coalesce(max(line) FILTER (h), 'Introduction') AS title, coalesce(max(CASE WHEN num THEN length(regexp_extract(line, '^(\d+(\.\d+)*)\.', 1)) - length(replace(regexp_extract(line, '^(\d+(\.\d+)*)\.', 1), '.', '')) + 1 WHEN up THEN 1 ELSE 2 END) FILTER (h), 0)::int AS level
        FROM p GROUP BY p_partkey, place HAVING count(*) FILTER (NOT h AND line <> '') > 0"""
)
def pdf_headings(spark, sf_dir):
    """Text of a page per part: numbered and upper-case headings, and lines that are none."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_PAGE.replace("chr(10)", "char(10)")).alias("content"))
    return X.pdf_sections(rows, "p_partkey").select("p_partkey", "place", "title", "level")


@query("SELECT conv_id, md5(string_agg('[PÁGINA ' || turn || ']' || chr(10) || t || chr(10), chr(10) ORDER BY turn)) AS content_md5 FROM (SELECT conv_id, turn, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS t FROM conversations) WHERE t <> '' GROUP BY conv_id")
def pdf_pages(spark, sf_dir):
    """Messages as pages of one document per conversation."""
    return X.page_text(table(spark, sf_dir, "conversations"), "conv_id", "turn", "text").select("conv_id", F.md5("content").alias("content_md5"))


@query(
    """SELECT doc_id, i AS chunk_index, n AS total_chunks, substr(text, (i * 800 + 1)::int, 1000) AS content FROM (SELECT doc_id, text, greatest(1, ceil((length(text) - 200) / 800.0))::int AS n FROM documents WHERE length(text) > 0), unnest(range(0, n)) AS u(i)"""
)
def fixed_chunks(spark, sf_dir):
    return K.fixed_chunks(_docs(spark, sf_dir))


def _boundary_sql(size: int, overlap: int) -> str:
    """One window after the other: each ends after the last mark in its second half, or is cut."""
    def last(mark: str) -> str:
        return f"CASE WHEN contains(w, {mark}) THEN length(w) - length(list_last(string_split(w, {mark}))) - length({mark}) ELSE -1 END"

    strip = r"regexp_replace(regexp_replace({0}, '^[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+', ''), '[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+$', '')"
    step = f"""SELECT doc_id, text, least(length(text), CASE WHEN s + {size} >= length(text) THEN length(text) WHEN a > {size / 2} THEN greatest(s + 1, s + a + 2 - {overlap}) WHEN b > {size / 2} THEN greatest(s + 1, s + b + 2 - {overlap})
        WHEN c > {size / 2} THEN greatest(s + 1, s + c + 1 - {overlap}) ELSE greatest(s + 1, s + {size} - {overlap}) END) AS s,
        CASE WHEN s + {size} >= length(text) THEN substr(text, s + 1) WHEN a > {size / 2} THEN substr(text, s + 1, a) WHEN b > {size / 2} THEN substr(text, s + 1, b + 1) WHEN c > {size / 2} THEN substr(text, s + 1, c) ELSE w END AS piece, n + 1 AS n
        FROM (SELECT *, {last("chr(10) || chr(10)")} AS a, {last("'. '")} AS b, {last("' '")} AS c FROM (SELECT doc_id, text, s, n, substr(text, s + 1, {size}) AS w FROM r WHERE s < length(text)))"""
    return f"""WITH RECURSIVE r AS (SELECT doc_id, text, 0::BIGINT AS s, NULL::VARCHAR AS piece, 0 AS n FROM documents WHERE text IS NOT NULL UNION ALL {step}),
        p AS (SELECT doc_id, n, {strip.format("piece")} AS content FROM r WHERE n > 0), k AS (SELECT doc_id, content, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS total FROM p WHERE content <> '')
        SELECT doc_id, i::int AS chunk_index, total::int AS total_chunks, md5(content) AS content_md5, CASE WHEN total > 1 THEN 'T (parte ' || (i + 1) || ')' ELSE 'T' END AS title FROM k"""


def _titled(chunks):
    return chunks.select("doc_id", "chunk_index", "total_chunks", F.md5("content").alias("content_md5"), K.part_titles(F.lit("T"), F.col("chunk_index"), F.col("total_chunks")).alias("title"))


@query(_boundary_sql(1000, 200))
def boundary_chunks(spark, sf_dir):
    return _titled(K.boundary_chunks(_docs(spark, sf_dir)))


@query(_boundary_sql(2000, 0))
def sync_chunks(spark, sf_dir):
    return _titled(K.boundary_chunks(_docs(spark, sf_dir), 2000, 0))


@query("SELECT doc_id, md5('[Relacionado con: a, b]' || chr(10) || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '[Concepto central]' || chr(10) || chr(10) ELSE '' END || source || chr(10) || chr(10) || text) AS m FROM documents")
def embedding_text(spark, sf_dir):
    kind = F.when(F.col("doc_id") % 2 == 0, "hub").otherwise("bridge")
    text = K.embedding_text(F.col("source"), F.col("text"), F.lit(None).cast("string"), F.array(F.lit("a"), F.lit("b")), kind)
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text).alias("m"))


@query("SELECT doc_id, substr(text, 1, 800) AS content, substr(source, 1, 500) AS context FROM documents")
def point_payload(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 800).alias("content"), F.substring("source", 1, 500).alias("context"))


def _versions(spark, sf_dir):
    """Two versions of the documents as sources: in the second every tenth is changed, some are gone and some are new."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    ledger = docs.filter("path % 11 <> 0").select("path", F.sha2("content", 256).alias("hash"))
    now = docs.filter("path % 7 <> 0").withColumn("content", F.when(F.col("path") % 10 == 0, F.concat("content", F.lit("!"))).otherwise(F.col("content")))
    return now, ledger


_SYNC = "CASE WHEN doc_id % 7 <> 0 AND doc_id % 11 = 0 THEN 'new' WHEN doc_id % 7 = 0 THEN 'deleted' WHEN doc_id % 10 = 0 THEN 'modified' ELSE 'unchanged' END AS status"


@query(f"SELECT doc_id AS path, {_SYNC} FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 11 <> 0")
def sync_diff(spark, sf_dir):
    return S.classify(*_versions(spark, sf_dir)).select("path", "status")


@query(f"SELECT status, count(*) AS n FROM (SELECT {_SYNC} FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 11 <> 0) GROUP BY status")
def sync_tally(spark, sf_dir):
    return S.tally(S.classify(*_versions(spark, sf_dir)))


@query("SELECT doc_id AS path, CASE WHEN doc_id % 10 = 0 OR doc_id % 11 = 0 THEN 'built' ELSE 'kept' END AS origin FROM documents WHERE doc_id % 7 <> 0")
def sync_apply(spark, sf_dir):
    now, ledger = _versions(spark, sf_dir)
    index = ledger.select("path", F.lit("kept").alias("origin"))
    return S.apply_sync(now, ledger, index, lambda fresh: fresh.select("path", F.lit("built").alias("origin")))[0]


@query("SELECT count(*) AS files, sum(length(text) // 1000 + 1) AS sections, sum(length(text) // 500 + 1) AS vectors FROM documents")
def ledger_totals(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.expr("length(text) div 1000 + 1").alias("sections"), F.sequence(F.lit(0), F.expr("cast(length(text) div 500 as int)")).alias("ids"))
    return rows.agg(F.count(F.lit(1)).alias("files"), F.sum("sections").alias("sections"), F.sum(F.size("ids")).alias("vectors"))


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    return windowed_counts(table(spark, sf_dir, "events"))


@query("SELECT p_partkey, 'ciudad=' || p_name || CASE WHEN p_partkey % 3 = 2 THEN '|persona=' || p_brand ELSE '' END AS found FROM part")
def json_tolerant(spark, sf_dir):
    """Answers as JSON, as JSON in prose, and as lines."""
    k, name = F.col("p_partkey") % 3, F.col("p_name")
    whole = F.concat(F.lit('{"ciudad": "'), name, F.lit('"}'))
    answer = F.when(k == 0, whole).when(k == 1, F.concat(F.lit("Here:\n```json\n"), whole, F.lit("\n```"))).otherwise(F.concat(F.lit("ciudad: "), name, F.lit("\n- persona: '"), "p_brand", F.lit("',")))
    found = P.tolerant_map(answer)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.transform(F.map_entries(found), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), "|").alias("found"))


_STORES: dict[tuple[str, str], tuple[N.Store, list[dict[str, int]]]] = {}


def _files(spark, sf_dir, version):
    """Documents as files: paragraphs, JSON, broken JSON, a format without a loader, and empty ones. The second version lacks
    some, has others changed, and some of the broken ones mended."""
    text = F.coalesce("text", F.lit(""))
    if version == 2:
        text = F.when(F.col("doc_id") % 10 == 0, F.concat(text, F.lit("!"))).otherwise(text)
    kind = F.col("doc_id") % 6
    broken = (kind == 3) & ((F.col("doc_id") % 30 != 3) | F.lit(version == 1))
    content = F.when(kind == 5, "").when(broken, F.concat(F.lit("{"), text)).when(kind.isin(2, 3), F.to_json(F.struct(text.alias("text")))).otherwise(text)
    if version == 2:
        content = F.when((kind == 5) & (F.col("doc_id") % 10 == 5), "filled").otherwise(content)
    path = F.concat(F.lit("d/"), "doc_id", F.when(kind.isin(2, 3), ".json").when(kind == 4, ".bin").otherwise(".txt"))
    rows = table(spark, sf_dir, "documents").select(path.alias("path"), content.alias("content"), "doc_id")
    return (rows.filter("doc_id % 7 <> 0") if version == 2 else rows).drop("doc_id")


def _ingested(spark, sf_dir):
    """A store after two runs, and their tallies; made by the session's first query that needs it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORES:
        store = N.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
        windows = lambda rows: K.fixed_chunks(rows, 1000, 200, "id", "text")
        _STORES[key] = (store, [N.ingest(_files(spark, sf_dir, v), store, v, chunk=windows) for v in (1, 2)])
    return _STORES[key]


_INGESTED = r"""t AS (SELECT doc_id, v, doc_id % 6 AS kind, coalesce(text, '') || CASE WHEN v = 2 AND doc_id % 10 = 0 THEN '!' ELSE '' END AS text FROM documents, (VALUES (1), (2)) AS x(v) WHERE v = 1 OR doc_id % 7 <> 0),
 c AS (SELECT *, kind = 3 AND (v = 1 OR doc_id % 30 <> 3) AS broken, CASE WHEN kind = 5 THEN CASE WHEN v = 2 AND doc_id % 10 = 5 THEN 'filled' ELSE '' END ELSE text END AS body, 'd/' || doc_id || CASE WHEN kind IN (2, 3) THEN '.json' WHEN kind = 4 THEN '.bin' ELSE '.txt' END AS path FROM t),
 p AS (SELECT path, v, generate_subscripts(a, 1) - 1 AS i, unnest(a) AS x FROM (SELECT path, v, string_split(body, chr(10) || chr(10)) AS a FROM c WHERE kind NOT IN (2, 3, 4))),
 q AS (SELECT path, v, i, regexp_replace(regexp_replace(x, '^\s+', ''), '\s+$', '') AS b FROM p),
 s AS (SELECT path, v, CASE WHEN contains(b, chr(10)) AND length(string_split(b, chr(10))[1]) < 100 THEN string_split(b, chr(10))[1] ELSE 'Paragraph ' || (i + 1) END AS title,
        CASE WHEN contains(b, chr(10)) AND length(string_split(b, chr(10))[1]) < 100 THEN regexp_replace(substr(b, length(string_split(b, chr(10))[1]) + 2), '^\s+', '') ELSE b END AS content FROM q WHERE b <> ''
       UNION ALL SELECT path, v, substr(body, 1, 50) || '...', body FROM c WHERE kind NOT IN (2, 3, 4) AND NOT EXISTS (SELECT 1 FROM q WHERE q.path = c.path AND q.v = c.v AND q.b <> '')
       UNION ALL SELECT path, v, 'text', text FROM c WHERE kind IN (2, 3) AND NOT broken),
 n AS (SELECT path, v, count(*) AS n_sections, sum(greatest(1, ceil((length(title) + 2 + length(content) - 200) / 800.0)))::BIGINT AS n_chunks, sum(length(content)) AS chars FROM s WHERE content <> '' GROUP BY ALL),
 e AS (SELECT c.*, CASE WHEN kind = 4 THEN 'no loader for: bin' WHEN trim(body) = '' AND NOT broken AND kind NOT IN (2, 3) THEN 'no text' WHEN broken THEN 'no valid JSON' WHEN n_chunks IS NULL THEN 'no sections' END AS error,
       coalesce(n_sections, 0) AS n_sections, coalesce(n_chunks, 0) AS n_chunks FROM c LEFT JOIN n USING (path, v)),
 one AS (SELECT path, v AS version, 'new' AS action, CASE WHEN error IS NULL THEN 'completed' ELSE 'error' END AS status, error, n_sections, n_chunks, text FROM e WHERE v = 1),
 two AS (SELECT e.path, e.v AS version, CASE WHEN one.status = 'completed' THEN CASE WHEN one.text = e.text THEN 'unchanged' ELSE 'modified' END ELSE 'new' END AS action, CASE WHEN e.error IS NULL THEN 'completed' ELSE 'error' END AS status, e.error,
         e.n_sections, e.n_chunks FROM e JOIN one USING (path) WHERE e.v = 2),
 every AS (SELECT * EXCLUDE (text) FROM one UNION ALL SELECT * FROM two UNION ALL SELECT path, 2, 'deleted', 'deleted', NULL, 0, 0 FROM one WHERE status = 'completed' AND path NOT IN (SELECT path FROM two))"""


@query(f"WITH {_INGESTED} SELECT * FROM every WHERE action <> 'unchanged'")
def ingest_ledger(spark, sf_dir):
    """How each file ended in two runs: broken files are rows with their error, all others land."""
    return _ingested(spark, sf_dir)[0].read("ledger").select("path", "version", "action", "status", "error", "n_sections", "n_chunks")


@query(
    f"""WITH {_INGESTED} SELECT version, count(*) FILTER (status = 'completed' AND action IN ('new', 'modified')) AS processed, count(*) FILTER (status = 'completed' AND action = 'new') AS added,
        count(*) FILTER (status = 'completed' AND action = 'modified') AS updated, count(*) FILTER (action = 'deleted') AS deleted, count(*) FILTER (action = 'unchanged') AS skipped, count(*) FILTER (status = 'error') AS errors FROM every GROUP BY version"""
)
def ingest_tally(spark, sf_dir):
    """What the two runs observed of themselves."""
    return spark.createDataFrame([{"version": k + 1} | t for k, t in enumerate(_ingested(spark, sf_dir)[1])])


@query(
    f"""WITH {_INGESTED}, z AS (SELECT path, arg_max(status, version) AS status, arg_max(n_chunks, version) AS n_chunks, arg_max(coalesce(error, ''), version) AS error FROM every WHERE action <> 'unchanged' GROUP BY path)
        SELECT c.path, CASE WHEN z.status = 'deleted' OR doc_id % 4 = 0 OR doc_id % 7 = 0 THEN 'pending' ELSE z.status END AS status, CASE WHEN z.status <> 'deleted' AND doc_id % 4 > 0 AND doc_id % 7 > 0 THEN z.n_chunks END AS n_chunks,
        CASE WHEN z.status = 'error' AND doc_id % 4 > 0 AND doc_id % 7 > 0 THEN nullif(z.error, '') END AS error FROM c JOIN z USING (path) WHERE (v = 2 OR doc_id % 7 = 0)"""
)
def ingest_status(spark, sf_dir):
    """Files after both runs, of which every fourth has changed once more and every seventh is back in another form."""
    files = _files(spark, sf_dir, 2).unionByName(_files(spark, sf_dir, 1).join(_files(spark, sf_dir, 2), "path", "left_anti").withColumn("content", F.concat("content", F.lit("?"))))
    changed = F.regexp_extract("path", r"(\d+)", 1).cast("long") % 4 == 0
    files = files.select("path", F.sha2(F.when(changed, F.concat("content", F.lit(" more"))).otherwise(F.col("content")), 256).alias("hash"))
    return _ingested(spark, sf_dir)[0].statuses(files)


_CURRENT = """now AS (SELECT path, max(version) AS v FROM every WHERE status <> 'error' GROUP BY path HAVING arg_max(status, version) = 'completed')"""


@query(f"WITH {_INGESTED}, {_CURRENT} SELECT path, n_sections, n_chunks, chars::BIGINT AS chars FROM n JOIN (SELECT path, max(version) FILTER (action <> 'unchanged') AS v FROM every JOIN now USING (path) WHERE status = 'completed' GROUP BY path) USING (path, v)")
def ingest_points(spark, sf_dir):
    """The current points by path, with the characters of their sections (overlaps of chunks counted once)."""
    points = _ingested(spark, sf_dir)[0].points("place", F.length("content").alias("chars"), (F.length("section") + 2).alias("title"))
    last = points.groupBy("path", "place").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("c"), F.first("title").alias("t"))
    return last.groupBy("path").agg(F.count(F.lit(1)).alias("n_sections"), F.sum("n").alias("n_chunks"), F.sum(F.col("c") - 200 * (F.col("n") - 1) - F.col("t")).alias("chars"))


@query(f"WITH {_INGESTED}, {_CURRENT} SELECT count(*) AS files, sum(n_sections)::BIGINT AS sections, sum(n_chunks)::BIGINT AS vectors FROM n JOIN (SELECT path, max(version) FILTER (action <> 'unchanged') AS v FROM every JOIN now USING (path) WHERE status = 'completed' GROUP BY path) USING (path, v)")
def ingest_totals(spark, sf_dir):
    return _ingested(spark, sf_dir)[0].totals()


@query(f"WITH {_INGESTED}, {_CURRENT} SELECT sum(n_chunks)::BIGINT AS n_docs, 1 AS generation, count(*) AS files FROM every JOIN now USING (path) WHERE status = 'completed' AND action <> 'unchanged' AND version = v - CASE WHEN EXISTS (SELECT 1 FROM every x WHERE x.path = every.path AND x.version = now.v AND x.action = 'unchanged') THEN 1 ELSE 0 END")
def ingest_compacted(spark, sf_dir):
    """The store after compaction into a folder of its own: chunks in the index made of its saved word counts, and files."""
    store = _ingested(spark, sf_dir)[0]
    copy = N.Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex}")
    for name in N.TABLES:
        copy.write(name, store.read(name), 0)
    generation = copy.compact()
    stats = copy.index()[2].select("n_docs", F.lit(generation).alias("generation"))
    return stats.crossJoin(copy.read("ledger").filter("status = 'completed'").agg(F.count(F.lit(1)).alias("files")))
