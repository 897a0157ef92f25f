"""Retrieval queries over documents and embeddings. By convention of this repository vec_id pairs with doc_id."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import keywords
from quillspark.operators import retrieval as R
from quillspark.operators import searching as S
from quillspark.operators.stages import shared_folder
from quillspark.queries import query, table

ASKED = "the ing of the andre thing"


def first_vector(spark, sf_dir) -> list[float]:
    """The query vector: that of vec_id 0, one row."""
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").select("embedding").first()[0]


_SAVED: dict[tuple[str, str], str] = {}


def saved_index(spark, sf_dir):
    """The BM25 index over the documents, saved by the session's first search that needs it and read by all others."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SAVED:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        R.bm25_index(table(spark, sf_dir, "documents"), path=path)
        _SAVED[key] = path
    return R.load_index(spark, _SAVED[key])


_BM25 = rf"""words AS (SELECT doc_id, regexp_extract_all(lower(text), '([\p{{L}}\p{{N}}_]+)', 1) AS w FROM documents),
 t AS (SELECT doc_id, unnest(w) AS term FROM words), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
 n AS (SELECT count(*) AS n_docs, avg(len(w)) AS avgdl FROM words), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 raw AS (SELECT term, df, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM df, n), m AS (SELECT avg(raw) AS avg_idf, count(*) AS n_terms FROM raw),
 idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * avg_idf ELSE raw END AS idf FROM raw, m),
 q AS (SELECT term, count(*) AS qf FROM (SELECT unnest(regexp_extract_all(lower('{ASKED}'), '([\p{{L}}\p{{N}}_]+)', 1)) AS term) GROUP BY 1),
 s AS (SELECT doc_id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avgdl))), 6) AS bm25_score
       FROM tf JOIN q USING (term) JOIN idf USING (term) JOIN words USING (doc_id), n GROUP BY doc_id)"""
_COS = """v AS (SELECT vec_id, label, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 6) AS score FROM embeddings)"""


@query(f"WITH {_BM25}, k AS (SELECT * FROM s ORDER BY bm25_score DESC, doc_id LIMIT 20) SELECT doc_id, bm25_score, row_number() OVER (ORDER BY bm25_score DESC, doc_id) AS lexical_rank FROM k WHERE bm25_score > 0")
def bm25_topk(spark, sf_dir):
    return R.bm25_search(saved_index(spark, sf_dir), ASKED, 20).withColumnRenamed("id", "doc_id")


@query(f"WITH {_BM25} SELECT n_docs, round(avgdl, 6) AS avgdl, n_terms, round(avg_idf, 6) AS avg_idf FROM n, m")
def bm25_corpus_stats(spark, sf_dir):
    stats = saved_index(spark, sf_dir)[2]
    return stats.select("n_docs", F.round("avgdl", 6).alias("avgdl"), "n_terms", F.round("avg_idf", 6).alias("avg_idf"))


@query(f"WITH {_COS} SELECT vec_id, label, score FROM v ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk(spark, sf_dir):
    return R.vector_search(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10)


@query(f"WITH {_COS} SELECT vec_id, label, score FROM v WHERE label = 3 ORDER BY score DESC, vec_id LIMIT 10")
def vector_topk_filtered(spark, sf_dir):
    return R.vector_search(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 10, filters={"label": 3})


@query(f"WITH {_COS} SELECT vec_id, label, score FROM v WHERE score >= 0.2 ORDER BY score DESC, vec_id LIMIT 15")
def vector_threshold(spark, sf_dir):
    return R.vector_search(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 15, threshold=0.2)


_FUSED = """k AS (SELECT * FROM s ORDER BY bm25_score DESC, doc_id LIMIT 20), l AS (SELECT doc_id AS key, row_number() OVER (ORDER BY bm25_score DESC, doc_id) AS r FROM k WHERE bm25_score > 0),
 e AS (SELECT vec_id AS key, row_number() OVER (ORDER BY score DESC, vec_id) AS r FROM (SELECT * FROM v ORDER BY score DESC, vec_id LIMIT 20)),
 f AS (SELECT key, e.r AS semantic_rank, l.r AS lexical_rank, round(coalesce(0.5 / (60 + e.r), 0) + coalesce(0.5 / (60 + l.r), 0), 9) AS rrf_score FROM e FULL JOIN l USING (key))"""


@query(f"WITH {_BM25}, {_COS}, {_FUSED} SELECT * FROM f")
def rrf_fusion(spark, sf_dir):
    hits = R.vector_search(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 20)
    semantic = hits.select(F.col("vec_id").alias("key"), F.row_number().over(W.orderBy(F.desc("score"), "vec_id")).alias("rank"))
    lexical = R.bm25_search(saved_index(spark, sf_dir), ASKED, 20).select(F.col("id").alias("key"), F.col("lexical_rank").alias("rank"))
    return R.rank_fusion(semantic, lexical)


@query(f"WITH {_BM25}, {_COS}, {_FUSED} SELECT * FROM f ORDER BY rrf_score DESC, semantic_rank NULLS LAST, lexical_rank, key LIMIT 10")
def hybrid_search(spark, sf_dir):
    index = saved_index(spark, sf_dir)
    return R.hybrid_search(table(spark, sf_dir, "embeddings"), index, ASKED, first_vector(spark, sf_dir), 10)


@query(
    f"""WITH {_COS}, c AS (SELECT vec_id, 'c' || label % 3 AS collection, label % 3 AS place, score FROM v),
        r AS (SELECT *, CASE WHEN score >= 2 THEN 0 WHEN score >= 1.9 THEN 1 END AS x, CASE WHEN score >= 0.5 THEN 0 WHEN score >= 0.4 THEN 1 WHEN score >= 0.3 THEN 2 END AS rung FROM c WHERE vec_id <> 0),
        b AS (SELECT * FROM r WHERE rung = (SELECT min(rung) FROM r)), g AS (SELECT * FROM b WHERE rung = 0 OR place = (SELECT min(place) FROM b)),
        k AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY score DESC, vec_id) AS n FROM g)
        SELECT vec_id, collection, score, rung FROM k WHERE n <= CASE WHEN rung = 0 THEN 5 ELSE 10 END ORDER BY score DESC, vec_id LIMIT 5"""
)
def search_ladder(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").filter("vec_id <> 0").withColumn("collection", F.concat(F.lit("c"), F.col("label") % 3))
    hits = R.search_ladder(points, first_vector(spark, sf_dir), ["c0", "c1", "c2"], "collection", 5, 0.5)
    return hits.select("vec_id", "collection", "score", "rung")


@query(
    """WITH q AS (SELECT n_nationkey AS id, CASE n_nationkey % 5 WHEN 0 THEN '¿Quién es ' WHEN 1 THEN '¿qué hay en ' WHEN 2 THEN '¿Cómo va ' WHEN 3 THEN '¿dónde cae ' ELSE '' END || n_name AS q FROM nation),
       x AS (SELECT id, [q || ' del documento', q || ' del archivo', q || ' en el documento', q || ' en el archivo', 'qué es ' || q, 'qué significa ' || q, 'qué contiene ' || q, 'qué incluye ' || q]
         || CASE WHEN regexp_matches(lower(q), 'quien|quién') THEN ['quién es ' || q, 'quién creó ' || q, 'quién preparó ' || q, 'quién hizo ' || q, 'quién escribió ' || q] ELSE [] END
         || CASE WHEN regexp_matches(lower(q), 'qué|que') THEN ['qué es ' || q, 'qué significa ' || q, 'qué contiene ' || q, 'qué incluye ' || q, 'qué representa ' || q] ELSE [] END
         || CASE WHEN regexp_matches(lower(q), 'cómo|como') THEN ['cómo es ' || q, 'cómo funciona ' || q, 'cómo se hace ' || q, 'cómo se utiliza ' || q, 'cómo se implementa ' || q] ELSE [] END
         || CASE WHEN regexp_matches(lower(q), 'dónde|donde') THEN ['dónde está ' || q, 'dónde se encuentra ' || q, 'dónde se ubica ' || q, 'dónde aparece ' || q] ELSE [] END AS l FROM q),
       u AS (SELECT id, unnest(l) AS expansion, generate_subscripts(l, 1) AS i FROM x) SELECT id, expansion, row_number() OVER (PARTITION BY id ORDER BY min(i)) AS place FROM u GROUP BY id, expansion"""
)
def query_expansion(spark, sf_dir):
    opening = F.element_at(F.array(*map(F.lit, ("¿Quién es ", "¿qué hay en ", "¿Cómo va ", "¿dónde cae ", ""))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), R.expansions(F.concat(opening, "n_name")).alias("l"))
    return rows.select("id", F.posexplode("l").alias("place", "expansion")).withColumn("place", F.col("place") + 1)


@query(
    f"""WITH {_BM25}, {_COS}, {_FUSED.replace("LIMIT 20", "LIMIT 24")}, b AS (SELECT doc_id, bm25_score FROM s WHERE bm25_score > 0 ORDER BY bm25_score DESC, doc_id LIMIT 12)
        SELECT 'semantic' AS mode, * FROM (SELECT vec_id AS key, score FROM v ORDER BY score DESC, vec_id LIMIT 12) UNION ALL SELECT 'lexical', doc_id, bm25_score FROM b
        UNION ALL SELECT 'hybrid', * FROM (SELECT key, rrf_score FROM f ORDER BY rrf_score DESC, semantic_rank NULLS LAST, lexical_rank, key LIMIT 12)"""
)
def search_modes(spark, sf_dir):
    points, v = table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir)
    index = saved_index(spark, sf_dir)
    found = [R.search_collection(m, points, index, ASKED, v, 12).withColumnRenamed(k, "score").withColumn("mode", F.lit(m)) for m, k in R.SCORE_KEYS.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query(
    f"""WITH e AS (SELECT vec_id, 'c' || label % 3 AS collection, label % 3 AS place, embedding::DOUBLE[] AS x FROM embeddings),
        q AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS rung, x AS y FROM e WHERE vec_id IN (1, 2, 3)),
        h AS (SELECT vec_id, collection, place, rung, round(list_cosine_similarity(x, y), 6) AS score FROM e, q WHERE vec_id > 3),
        g AS (SELECT * FROM h WHERE score >= 0.25), b AS (SELECT rung, place FROM g ORDER BY rung, place LIMIT 1)
        SELECT vec_id, collection, rung, score FROM g JOIN b USING (rung, place) ORDER BY score DESC, vec_id LIMIT 5"""
)
def search_rewordings(spark, sf_dir):
    """Vectors 1 to 3 stand for those of three rewordings."""
    points = table(spark, sf_dir, "embeddings").withColumn("collection", F.concat(F.lit("c"), F.col("label") % 3))
    asked = points.filter("vec_id in (1, 2, 3)").select("vec_id", "embedding").orderBy("vec_id").collect()
    hits = R.search_expanded(points.filter("vec_id > 3"), [r["embedding"] for r in asked], ["c0", "c1", "c2"], "collection", 5, 0.25)
    return hits.select("vec_id", "collection", F.col("rung").cast("long").alias("rung"), "score")


_COLLECTIONS = ["c0", "c1", "c2"]
_UNHEARD = "zzzz qqqq"


def _chunk_rows(spark, sf_dir, vectors=True):
    """Documents as chunks of three collections: their source is the file and the parent, some sections repeat, some authors say nothing."""
    docs = table(spark, sf_dir, "documents").withColumn("embedding", F.lit(None).cast("array<double>"))
    if vectors:
        docs = docs.drop("embedding").join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id", "left")
    section = F.when(F.col("doc_id") % 7 < 5, F.concat(F.lit("part "), F.col("doc_id") % 40)).otherwise("")
    file = F.when(F.col("doc_id") % 7 < 6, F.col("source")).otherwise("")
    author = F.when(F.col("doc_id") % 4 == 0, "Autor").otherwise(F.col("source"))
    return docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("c"), F.col("doc_id") % 3).alias("collection"), "embedding", file.alias("file"), section.alias("section"), F.coalesce("text", F.lit("")).alias("content"), F.col("source").alias("parent_id"), author.alias("author"), "lang", (F.col("doc_id") / 10).cast("int").alias("chunk_index"))


def _chunk_index(spark, sf_dir):
    """The index by collection, from the documents alone: texts are not joined to vectors for it."""
    key = (spark.sparkContext.applicationId, f"{sf_dir} by collection")
    if key not in _SAVED:
        path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
        R.bm25_index(_chunk_rows(spark, sf_dir, vectors=False), "id", "content", by=("collection",), path=path)
        _SAVED[key] = path
    return R.load_index(spark, _SAVED[key])


_CHUNK_SQL = r"""d AS (SELECT doc_id AS id, doc_id % 3 AS place, 'c' || doc_id % 3 AS collection, embedding::DOUBLE[] AS x, CASE WHEN doc_id % 7 < 6 THEN source ELSE '' END AS file,
 CASE WHEN doc_id % 7 < 5 THEN 'part ' || doc_id % 40 ELSE '' END AS section, coalesce(text, '') AS content, source AS parent_id, CASE WHEN doc_id % 4 = 0 THEN 'Autor' ELSE source END AS author, lang, doc_id // 10 AS chunk_index FROM documents LEFT JOIN embeddings ON vec_id = doc_id),
 words AS (SELECT id, collection, regexp_extract_all(lower(content), '([\p{L}\p{N}_]+)', 1) AS w FROM d), tf AS (SELECT collection, id, term, count(*) AS tf FROM (SELECT collection, id, unnest(w) AS term FROM words) GROUP BY ALL),
 n AS (SELECT collection, count(*) AS n_docs, avg(len(w)) AS avgdl FROM words GROUP BY 1), df AS (SELECT collection, term, count(*) AS df FROM tf GROUP BY ALL),
 raw AS (SELECT collection, term, ln(n_docs - df + 0.5) - ln(df + 0.5) AS raw FROM df JOIN n USING (collection)), m AS (SELECT collection, avg(raw) AS avg_idf FROM raw GROUP BY 1),
 idf AS (SELECT collection, term, CASE WHEN raw < 0 THEN 0.25 * avg_idf ELSE raw END AS idf FROM raw JOIN m USING (collection))"""


def _search_sql(mode, asked, vectors, threshold, k, wordings=(), keep="true", rerank=None, whole=False):
    """The same search, step by step. vectors: SQL with the columns variant and y."""
    tries = [(1, 0, threshold, k)]
    at = threshold
    while at > 0.3 + 1e-9:
        at = max(0.3, at - 0.1)
        tries.append((2, 0, round(at, 1), 2 * k))
    tries += [(3, j + 1, threshold, k) for j in range(len(wordings))] + [(4, 0, 0.3, k)]
    rungs = ", ".join(f"({i}, {s}, {v}, {t}::DOUBLE, {n})" for i, (s, v, t, n) in enumerate(tries))
    texts = ", ".join(f"({i}, '{t}')" for i, t in enumerate([asked, *wordings]))
    words = "[" + ", ".join(f"'{w}'" for w in dict.fromkeys(asked.lower().split()) if len(w) > 2 and w not in ("the", "of")) + "]"
    legs = {"semantic": "leg = 0 AND score >= threshold AND rank <= n", "lexical": "leg = 1 AND rank <= n", "hybrid": "(leg = 1 OR score >= threshold) AND rank <= 2 * n"}[mode]
    main = f"""SELECT rung, strategy, n, collection, place, rank, score AS value, id FROM t WHERE strategy < 4 AND {legs}"""
    if mode == "hybrid":
        main = f"""SELECT rung, strategy, n, collection, place, rank, value, id FROM (SELECT *, row_number() OVER (PARTITION BY rung, collection ORDER BY value DESC, first, id) AS rank FROM (
            SELECT rung, strategy, n, collection, any_value(place) AS place, arg_min(id, leg * 1000 + rank) AS id, min(leg * 1000 + rank) AS first, round(sum(0.5 / (60 + rank)), 9) AS value FROM t WHERE strategy < 4 AND {legs} GROUP BY rung, strategy, n, collection, key)) WHERE rank <= n"""
    final = "value" if rerank is None else f"round(len(list_intersect({rerank[0]}, list_distinct(regexp_extract_all(lower(content), '([\\p{{L}}\\p{{N}}_]+)', 1)))) / {len(eval(rerank[0]))}.0, 6)"
    top = k if rerank is None else rerank[1]
    rows = "SELECT id, parent_id, content, score, 1::BIGINT AS child_count FROM top"
    if whole:
        rows = "SELECT arg_max(id, (score, -spot)) AS id, parent_id, 'all of ' || parent_id AS content, max(score) AS score, count(*) AS child_count FROM top GROUP BY parent_id"
    return rf"""(WITH {_CHUNK_SQL}, q AS ({vectors}), own AS (SELECT * FROM d WHERE {keep}),
 a AS (SELECT variant, term, count(*) AS qf FROM (SELECT variant, unnest(regexp_extract_all(lower(txt), '([\p{{L}}\p{{N}}_]+)', 1)) AS term FROM (VALUES {texts}) AS v(variant, txt)) GROUP BY ALL),
 s AS (SELECT 0 AS leg, variant, id, round(list_cosine_similarity(x, y), 6) AS score FROM own, q WHERE x IS NOT NULL),
 b AS (SELECT 1 AS leg, variant, id, round(sum(qf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(w) / avgdl))), 6) AS score FROM tf JOIN a USING (term) JOIN idf USING (collection, term) JOIN words USING (collection, id) JOIN n USING (collection) GROUP BY variant, id),
 u AS (SELECT * FROM s WHERE score >= least(0.3, {threshold}) UNION ALL SELECT * FROM b WHERE score > 0),
 h AS (SELECT u.*, own.* EXCLUDE (id, x), row_number() OVER (PARTITION BY leg, variant, collection ORDER BY score DESC, id) AS rank, CASE WHEN file <> '' OR section <> '' THEN file || '::' || section ELSE sha256(content) END AS key FROM u JOIN own USING (id)),
 t AS (SELECT * FROM h JOIN (VALUES {rungs}) AS r(rung, strategy, variant, threshold, n) USING (variant) WHERE rank <= {4 * k}),
 near AS (SELECT *, row_number() OVER (PARTITION BY collection ORDER BY rank) AS r FROM t WHERE strategy = 4 AND leg = 0 AND score >= 0.3 AND rank <= 3 * n AND len([z FOR z IN {words} IF contains(lower(content), z) OR contains(lower(section), z)]) > 0),
 ans AS ({main} UNION ALL SELECT rung, strategy, n, collection, place, r, score, id FROM near WHERE r <= n),
 f AS (SELECT * FROM ans WHERE rung = (SELECT min(rung) FROM ans) AND (strategy IN (1, 4) OR place = (SELECT min(place) FROM ans WHERE rung = (SELECT min(rung) FROM ans)))),
 p AS (SELECT f.*, d.* EXCLUDE (id, place, collection, x), CASE WHEN lower(author) NOT IN ('', 'autor', 'author') AND length(author) > 3 THEN 0
   WHEN len([z FOR z IN {words} IF contains(lower(content), z)]) > 0 OR regexp_matches(lower(content), '[a-z]+\s+[a-z]+|\d{{2,}}/\d{{2}}/\d{{4}}|(^|[^\p{{L}}\p{{N}}_])[a-z]{{4,}}($|[^\p{{L}}\p{{N}}_])') THEN 1 ELSE 2 END AS prio FROM f JOIN d USING (id)),
 o AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN strategy > 1 THEN -value END, prio, place, rank, id) AS pos FROM p),
 top AS (SELECT *, row_number() OVER (ORDER BY score DESC, pos) AS spot FROM (SELECT *, {final} AS score FROM o WHERE strategy = 1 OR pos <= {k} ORDER BY score DESC, pos LIMIT {top})),
 rows AS ({rows})
 SELECT rows.id, top.collection, top.file, top.section, md5(rows.content) AS content_md5, rows.parent_id, rows.score, top.strategy, top.rung, rows.child_count, round(avg(rows.score) OVER (), 6) AS avg_score FROM rows JOIN top USING (id))"""


def _told(found):
    return found.withColumn("content", F.md5("content")).withColumnRenamed("content", "content_md5")


_ASKED_WORDS = "['the', 'ing', 'of', 'andre', 'thing']"
_ONE = "SELECT 0 AS variant, embedding::DOUBLE[] AS y FROM embeddings WHERE vec_id = 0"


@query(_search_sql("hybrid", ASKED, _ONE, 0.2, 10, rerank=(_ASKED_WORDS, 8), whole=True)[1:-1])
def search_end_to_end(spark, sf_dir):
    """Hybrid search over three collections, reranking by shared words, and the sources of the documents as parents."""
    chunks = _chunk_rows(spark, sf_dir)
    parents = chunks.select("parent_id").distinct().withColumn("parent_content", F.concat(F.lit("all of "), "parent_id"))
    return _told(S.search(chunks, _chunk_index(spark, sf_dir), ASKED, [first_vector(spark, sf_dir)], _COLLECTIONS, "hybrid", 10, 0.2, scorer=R.overlap_score(ASKED), top=8, parents=parents))


@query(
    f"""WITH {_BM25}, {_COS}, d AS (SELECT doc_id AS id, CASE WHEN doc_id % 7 < 6 THEN source ELSE '' END AS file, CASE WHEN doc_id % 7 < 5 THEN 'part ' || doc_id % 40 ELSE '' END AS section, coalesce(text, '') AS content FROM documents),
        e AS (SELECT 0 AS leg, vec_id AS id, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank FROM v JOIN documents ON doc_id = vec_id), l AS (SELECT 1 AS leg, doc_id, bm25_score, row_number() OVER (ORDER BY bm25_score DESC, doc_id) AS rank FROM s WHERE bm25_score > 0),
        u AS (SELECT * FROM e WHERE rank <= 200 UNION ALL SELECT * FROM l WHERE rank <= 200), k AS (SELECT u.*, CASE WHEN file <> '' OR section <> '' THEN file || '::' || section ELSE sha256(content) END AS key FROM u JOIN d USING (id))
        SELECT key, arg_min(id, leg * 1000 + rank) AS id, round(sum(0.5 / (60 + rank)), 9) AS rrf_score, min(rank) FILTER (leg = 0) AS semantic_rank, min(rank) FILTER (leg = 1) AS lexical_rank, max(score) FILTER (leg = 0) AS semantic_score, max(score) FILTER (leg = 1) AS bm25_score FROM k GROUP BY key"""
)
def rrf_by_section(spark, sf_dir):
    """200 hits of each leg as one row per file and section, or per text where both are empty; the first hit by meaning lends its id."""
    chunks = _chunk_rows(spark, sf_dir)
    semantic = R.vector_search(chunks.filter("embedding is not null"), first_vector(spark, sf_dir), 200, id_col="id").select("id", "score").withColumn("leg", F.lit(0))
    lexical = R.bm25_search(saved_index(spark, sf_dir), ASKED, 200).select("id", F.col("bm25_score").alias("score")).withColumn("leg", F.lit(1))
    rank = F.row_number().over(W.partitionBy("leg").orderBy(F.desc("score"), "id"))
    hits = semantic.unionByName(lexical).withColumn("rank", rank)
    hits = chunks.select("id", S.hit_key(F.col("file"), F.col("section"), F.col("content")).alias("key")).join(F.broadcast(hits), "id")
    return S.fused(hits, [], ["id"]).drop("first")


_BETWEEN = "SELECT 0 AS variant, [(z[1] + z[2]) / 2 FOR z IN list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[])] AS y FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND b.vec_id = 1"
_EACH = "SELECT vec_id AS variant, embedding::DOUBLE[] AS y FROM embeddings WHERE vec_id <= 8"


@query(
    f"""SELECT 'lower thresholds' AS search, * FROM {_search_sql("semantic", ASKED, _BETWEEN, 0.95, 4)} UNION ALL
        SELECT 'other wordings', * FROM {_search_sql("lexical", _UNHEARD, _EACH, 0.5, 6, wordings=R.expand_query(_UNHEARD), keep="lang = 'es'")} UNION ALL
        SELECT 'keywords', * FROM {_search_sql("lexical", "tio ent", _ONE, 0.5, 20)}"""
)
def search_strategies(spark, sf_dir):
    """Three searches of which each falls through to another strategy; the first strategy answers search_end_to_end."""
    chunks = _chunk_rows(spark, sf_dir)
    index = _chunk_index(spark, sf_dir)
    some = table(spark, sf_dir, "embeddings").filter("vec_id <= 8").orderBy("vec_id").select("embedding").collect()  # query vectors
    v = [r["embedding"] for r in some]
    found = {
        "lower thresholds": S.search(chunks, None, ASKED, [[(a + b) / 2 for a, b in zip(v[0], v[1], strict=True)]], _COLLECTIONS, "semantic", 4, 0.95),
        "other wordings": S.search(chunks, index, _UNHEARD, v, _COLLECTIONS, "lexical", 6, 0.5, {"lang": "es"}, wordings=R.expand_query(_UNHEARD)),
        "keywords": S.search(chunks, index, "tio ent", v[:1], _COLLECTIONS, "lexical", 20, 0.5),
    }
    rows = [f.select(F.lit(name).alias("search"), "*") for name, f in found.items()]
    return _told(rows[0].unionByName(rows[1]).unionByName(rows[2]))


@query(
    f"""WITH {_COS}, h AS (SELECT v.*, text FROM v JOIN documents ON vec_id = doc_id ORDER BY score DESC, vec_id LIMIT 30) SELECT vec_id, score FROM h WHERE score >= -1 AND (contains(lower(text), 'andre') OR contains(lower(text), 'tion')) ORDER BY score DESC, vec_id LIMIT 10"""
)
def keyword_filter_search(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text"), "vec_id")
    return R.keyword_search(points, "text", "the tion of andre", first_vector(spark, sf_dir), 10, -1.0).select("vec_id", "score")


_CHUNKS = """ch AS (SELECT doc_id, i AS chunk_index, substr(text, (i * 500 + 1)::int, 500) AS content FROM documents, unnest(range(0, greatest(1, ceil(length(text) / 500.0))::int)) AS u(i) WHERE length(text) > 0)"""


def _chunks(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter(F.length("text") > 0)
    n = F.greatest(F.lit(1), F.ceil(F.length("text") / F.lit(500))).cast("int")
    rows = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    return rows.select("doc_id", "chunk_index", F.substr(F.col("text"), F.col("chunk_index") * 500 + 1, F.lit(500)).alias("content"))


@query(
    f"""WITH {_CHUNKS}, h AS (SELECT doc_id AS parent_id, chunk_index, doc_id * 1000000 + chunk_index AS id, (length(content) % 7) / 10.0 AS score FROM ch)
        SELECT parent_id, arg_max(id, (score, -chunk_index)) AS id, max(score) AS score, count(*) AS child_count, list(score ORDER BY chunk_index) AS child_scores,
        md5(max((SELECT text FROM documents d WHERE d.doc_id = parent_id))) AS content_md5 FROM h GROUP BY parent_id"""
)
def parent_expand(spark, sf_dir):
    hits = _chunks(spark, sf_dir).select((F.col("doc_id") * 1000000 + F.col("chunk_index")).alias("id"), F.col("doc_id").alias("parent_id"), "content", (F.length("content") % 7 / 10).alias("score"), F.col("chunk_index").alias("pos"))
    parents = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("parent_id"), F.col("text").alias("parent_content"))
    return R.expand_parents(hits, parents).select("parent_id", "id", "score", "child_count", "child_scores", F.md5("content").alias("content_md5"))


@query(
    f"""WITH {_CHUNKS}, w AS (SELECT doc_id AS parent_id, chunk_index, md5(array_to_string(list(content) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), chr(10))) AS window_md5 FROM ch)
        SELECT * FROM w"""
)
def windowed_parents(spark, sf_dir):
    chunks = _chunks(spark, sf_dir).withColumnRenamed("doc_id", "parent_id")
    return R.windowed_parents(chunks, chunks.select("parent_id", "chunk_index")).select("parent_id", "chunk_index", F.md5("window_content").alias("window_md5"))


@query(
    f"""WITH {_CHUNKS}, {_COS}, w AS (SELECT doc_id * 1000000 + chunk_index AS id, doc_id, md5(array_to_string(list(content) OVER (PARTITION BY doc_id ORDER BY chunk_index ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), chr(10))) AS content_md5 FROM ch),
        k AS (SELECT id, score, content_md5, row_number() OVER (PARTITION BY doc_id % 3 ORDER BY score DESC, id) AS r, doc_id % 3 AS place FROM w JOIN v ON vec_id = doc_id WHERE score >= 0.2),
        t AS (SELECT * FROM k WHERE r <= 12 ORDER BY score DESC, place, r LIMIT 12) SELECT id, score, content_md5, round(avg(score) OVER (), 6) AS avg_score FROM t"""
)
def search_windowed(spark, sf_dir):
    """Chunks of 500 characters, each with the vector of its document, found with their neighbours."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    chunks = _chunks(spark, sf_dir).join(vectors, "doc_id", "left").withColumn("collection", F.concat(F.lit("c"), F.col("doc_id") % 3))
    chunks = chunks.withColumns({"id": F.col("doc_id") * 1000000 + F.col("chunk_index"), "file": F.lit(""), "section": F.lit(""), "author": F.lit("known name")}).withColumnRenamed("doc_id", "parent_id")
    return _told(S.search(chunks, None, ASKED, [first_vector(spark, sf_dir)], _COLLECTIONS, "semantic", 12, 0.2, window=1)).select("id", "score", "content_md5", "avg_score")


@query(
    f"""WITH {_COS}, k AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM v)
        SELECT vec_id, label, score, r FROM k WHERE r <= 3 ORDER BY score DESC, vec_id LIMIT 12"""
)
def multi_collection_topk(spark, sf_dir):
    return R.best_per_collection(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 3, 12, "label")


@query(
    """SELECT doc_id AS id, CASE WHEN quality = 1 AND toxic = 0 THEN 0 WHEN quality IS NOT NULL THEN 1 ELSE 2 END AS priority,
       row_number() OVER (ORDER BY CASE WHEN quality = 1 AND toxic = 0 THEN 0 WHEN quality IS NOT NULL THEN 1 ELSE 2 END, doc_id) AS rank FROM documents LEFT JOIN labels USING (doc_id)"""
)
def priority_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("pos"), "quality", "toxic")
    good = F.coalesce((F.col("quality") == 1) & (F.col("toxic") == 0), F.lit(False))
    return R.merge_by_quality(rows, good, F.col("quality").isNotNull()).select("id", "priority", "rank")


@query(
    r"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Autor' WHEN doc_id % 3 = 1 THEN source END AS author, CASE WHEN doc_id % 5 = 0 THEN '1 2 ' || doc_id WHEN doc_id % 5 = 1 THEN 'x' || doc_id ELSE coalesce(text, '') END AS content FROM documents)
       SELECT doc_id AS id, CASE WHEN lower(coalesce(author, '')) NOT IN ('', 'autor', 'author') AND length(author) > 3 AND NOT regexp_matches(author, '^\s*$') THEN 0
         WHEN contains(lower(content), 'tion') OR regexp_matches(lower(content), '[a-z]+\s+[a-z]+|\d{2,}/\d{2}/\d{4}|(^|[^\p{L}\p{N}_])[a-z]{4,}($|[^\p{L}\p{N}_])') THEN 1 ELSE 2 END AS priority FROM p"""
)
def content_priority(spark, sf_dir):
    """Documents by what is known of them: an author's name, else a text that says something, else neither."""
    k = F.col("doc_id")
    author = F.when(k % 3 == 0, "Autor").when(k % 3 == 1, F.col("source"))
    content = F.when(k % 5 == 0, F.concat(F.lit("1 2 "), k)).when(k % 5 == 1, F.concat(F.lit("x"), k)).otherwise(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select(k.alias("id"), S.priority(author, content, F.lit("the tion of")).alias("priority"))


_KW = "['tion', 'the', 'andre', 'zzz']"


@query(
    f"""WITH {_COS}, h AS (SELECT v.vec_id AS id, score, text FROM v JOIN documents ON vec_id = doc_id ORDER BY score DESC, vec_id LIMIT 30)
        SELECT id, score AS original_score, round(len(list_intersect({_KW}, list_distinct(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}_]+)', 1)))) / 4.0, 6) AS rerank_score FROM h ORDER BY rerank_score DESC, original_score DESC, id LIMIT 10"""
)
def rerank_overlap(spark, sf_dir):
    points = table(spark, sf_dir, "embeddings").join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), F.col("text").alias("content")), "vec_id")
    hits = R.vector_search(points, first_vector(spark, sf_dir), 30).withColumnRenamed("vec_id", "id")
    return R.rerank(hits, R.overlap_score("tion the andre zzz"), 10).select("id", "original_score", "rerank_score")


@query("SELECT round(avg(coalesce(score, 0)), 6) AS avg_score, count(*) AS n FROM (WITH " + _COS + " SELECT score FROM v ORDER BY score DESC, vec_id LIMIT 25)")
def mean_hit_score(spark, sf_dir):
    hits = R.vector_search(table(spark, sf_dir, "embeddings"), first_vector(spark, sf_dir), 25)
    return hits.agg(F.round(F.avg(F.coalesce("score", F.lit(0.0))), 6).alias("avg_score"), F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(text), 'tion') OR contains(lower(text), 'heer')")
def message_keyword_filter(spark, sf_dir):
    hit = F.exists(keywords(F.lit("tion heer of")), lambda w: F.contains(F.lower("text"), w))
    return table(spark, sf_dir, "conversations").filter(hit).select("conv_id", "turn")


def flagship(spark, sf_dir):
    """The whole search over the documents: both ways of finding, fused, reranked, and expanded to sources."""
    return search_end_to_end(spark, sf_dir)
