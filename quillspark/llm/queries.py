"""The registered queries of the training-data operators, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.bpe import bpe_decode, bpe_encode
from quillspark.llm.common import documents
from quillspark.llm.conversation_repair import repair_conversations, repaired_hashes
from quillspark.llm.exact_dedup import exact_dedup
from quillspark.llm.html_extract import extract_main_text
from quillspark.llm.jaccard_join import jaccard_components
from quillspark.llm.language_id import identify_language, train_language_model
from quillspark.llm.license_scan import license_scan
from quillspark.llm.mixing import labelled_domains, mix_to_targets
from quillspark.llm.repetition_quality import repetition_quality
from quillspark.llm.sanitise import KINDS, personal_data
from quillspark.llm.sentence_pieces import piece_decode, piece_encode
from quillspark.llm.suffix_dedup import suffix_dedup
from quillspark.llm.vector_codes import codebooks_digest, encode_vectors, with_totals


def op1_repetition_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_quality(documents(spark, sf_dir, "doc_id", "text"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup(documents(spark, sf_dir, "doc_id", "text"), hash_all=True)
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths; a document counts as file <source>/<doc_id div 1000>/<doc_id div 100>/<doc_id>."""
    block = F.concat_ws("/", "source", F.expr("doc_id div 1000"), F.expr("doc_id div 100"), "doc_id")
    return license_scan(documents(spark, sf_dir, "doc_id", "text", "source").withColumn("path", block))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(documents(spark, sf_dir, "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), "n_shared")


#: Shares of the mixture's tokens by domain of the table of labels.
TARGETS = {"good": 0.9, "poor": 0.1, "toxic": 0.0}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "source")
    labelled = labelled_domains(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = mix_to_targets(docs, labelled, TARGETS, keep=["source"])
    return out.withColumn("posterior", F.transform("posterior", lambda p: F.round(p, 6)))


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe_encode(documents(spark, sf_dir, "doc_id", "text"), vocabulary_path()).drop("text")
    decoded = bpe_decode(encoded, vocabulary_path())
    return decoded.select("doc_id", F.expr("octet_length(ids) div 4").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.col(id_col).cast("string")) % 3 == 1


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text", "lang")
    model = train_language_model(docs.filter(~held_out()))
    return identify_language(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir, "doc_id", "text"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(documents(spark, sf_dir, "doc_id", "text"))

    def listed(keep):
        return F.array_join(F.transform(F.filter("spans", keep), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.sha2(listed(lambda s: s["kind"].isin(*KINDS)), 256).alias("base_sha256")
    return found.select("doc_id", *map(count, KINDS), base, listed(lambda s: F.lit(True)).alias("spans"), F.size("spans").cast("long").alias("n_spans"), count("term"), F.sha2("sanitised", 256).alias("sanitised_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    rows, books = encode_vectors(vectors, keep=("label",))
    out = with_totals(rows, "label", "error", "label_error")
    return out.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))


def piece_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """borders_sha256 is of the source bytes where pieces begin and end, as little-endian signed 64-bit integers."""
    encoded = piece_encode(documents(spark, sf_dir, "doc_id", "text"), piece_model_path()).drop("text")
    decoded = piece_decode(encoded, piece_model_path(), listed_col="listed")
    n = F.expr("octet_length(ids) div 4").alias("n_tokens")
    return decoded.select("doc_id", n, F.sha2("listed", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), F.sha2("borders", 256).alias("borders_sha256"))


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations damaged by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its text, 2 takes its `.!?`, 3 repeats it, 4 makes it a user's."""
    blank = F.lit(" ")
    lot = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    text, role = F.coalesce("text", blank), F.coalesce("role", blank)
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), lot.alias("_lot")).filter("_lot <> 0")
    rows = rows.withColumn("text", F.when(F.col("_lot") == 1, "").when(F.col("_lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    rows = rows.withColumn("role", F.when(F.col("_lot") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.when(F.col("_lot") == 3, 2).otherwise(1)))).drop("_n", "_lot")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    report, repaired = repair_conversations(damaged(table))
    every = table.select("conv_id").distinct().withColumn("c", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("")))
    out = every.join(report.drop("conv_id"), "c", "left").join(repaired_hashes(repaired), "c", "left")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_repetition_quality": op1_repetition_quality,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_license_scan": op3_license_scan,
    "op4_bpe": op4_bpe,
    "op5_language_id": op5_language_id,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_mixing": op7_mixing,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_html_extraction": op9_html_extraction,
    "op10_personal_data": op10_personal_data,
    "op11_vector_codes": op11_vector_codes,
    "op12_sentence_pieces": op12_sentence_pieces,
    "op13_conversation_repair": op13_conversation_repair,
}

#: DuckDB text with the letters A-Z of a column lower-cased.
_LOWERED = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"



def _vector_codes_sql(rounds: int = 4) -> str:
    """The rounds of op11 one after another: cross joins with the few entries are what DuckDB does with a small table."""
    ctes = ["""
        k AS (SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
              WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
        n AS (SELECT k.*, row_number() OVER (ORDER BY vec_id) - 1 AS r FROM k),
        p AS (SELECT r, vec_id, label, part, v[1 + part * (len(v) // 4) : (1 + part) * (len(v) // 4)] AS x FROM n, (SELECT unnest([0, 1, 2, 3]) AS part)),
        b0 AS (SELECT part, r AS e, x AS y FROM p WHERE r < 256)"""]
    for k in range(rounds + 1):
        ctes.append(f"""
        a{k} AS MATERIALIZED (SELECT p.r, p.part, min(list_sum([(z[1] - z[2]) * (z[1] - z[2]) FOR z IN list_zip(p.x, b.y)])::BIGINT * 256 + b.e) AS best
               FROM p JOIN b{k} b ON b.part = p.part GROUP BY p.r, p.part)""")
        if k < rounds:
            ctes.append(f"""
        s{k} AS (SELECT p.part, best % 256 AS e, i, sum(x[i])::BIGINT AS s, count(*) AS m
                 FROM p JOIN a{k} USING (r, part), (SELECT unnest(generate_series(1, (SELECT max(len(x)) FROM p))) AS i) GROUP BY ALL),
        b{k + 1} AS MATERIALIZED (SELECT b.part, b.e, coalesce(m.y, b.y) AS y FROM b{k} b LEFT JOIN
               (SELECT part, e, list((s - ((s % m) + m) % m) // m ORDER BY i) AS y FROM s{k} GROUP BY part, e) m ON m.part = b.part AND m.e = b.e)""")
    return f"""
        WITH {",".join(ctes)},
        c AS (SELECT vec_id, label, string_agg(format('{{:02x}}', best % 256), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error
              FROM a{rounds} JOIN p USING (r, part) GROUP BY r, vec_id, label)
        SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error,
               (SELECT sha256(string_agg(array_to_string(y, ','), ',' ORDER BY part, e)) FROM b{rounds}) AS codebooks_sha256 FROM c"""


ORACLES: dict[str, str] = {
    "op2_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWERED.format("text")}) AS text_sha256 FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = max(doc_id) OVER w AS kept, text_sha256
        FROM d WINDOW w AS (PARTITION BY text_sha256)""",
    "op11_vector_codes": _vector_codes_sql(),
}
