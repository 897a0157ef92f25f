"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import blocks_of, mixed, short_batches

UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class LanguageModel:
    """langs in order of name; log_prob[n-gram bucket, lang]; log_prior[lang]."""

    langs: list[str]
    log_prob: np.ndarray
    log_prior: np.ndarray
    buckets: int
    orders: tuple[int, ...]


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters; every run of other characters becomes one blank, as do both ends."""
    chars = _OTHER.sub(" ", text.lower()).strip(" ")
    return np.frombuffer(f" {chars} ".encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(texts: list[str], buckets: int, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Row number of the text and bucket of every n-gram."""
    codes = [_codes(t) for t in texts]
    rows = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
    flat = np.concatenate(codes).astype(np.uint64) if codes else np.zeros(0, np.uint64)
    found, of = [], []
    for n in orders:
        if len(flat) < n:
            continue
        key = np.full(len(flat) - n + 1, n, np.uint64)
        for k in range(n):
            key = key * np.uint64(0x100000001B3) + flat[k : len(flat) - n + 1 + k]
        inside = rows[: len(key)] == rows[n - 1 :]
        found.append((mixed(key)[inside] % np.uint64(buckets)).astype(np.int64))
        of.append(rows[: len(key)][inside])
    return (np.concatenate(of), np.concatenate(found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def train_language_model(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = 1 << 15, orders: tuple[int, ...] = (1, 2, 3), smoothing: float = 0.5) -> LanguageModel:
    """Fit on every row of labelled with a text and a label; the counts are summed by Spark, language by language.

    The result has buckets x languages numbers and does not grow with the rows. No rows give a model without languages,
    which answers `und` always.
    """
    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).dropna()
    short_batches(labelled.sparkSession)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        docs: dict[str, int] = {}
        for batch in batches:
            for lang, own in batch.groupby("lang")["text"]:
                texts = list(own)
                counts = total.setdefault(lang, np.zeros(buckets, np.int64))
                docs[lang] = docs.get(lang, 0) + len(texts)
                for a, b in blocks_of(texts):
                    counts += np.bincount(_grams(texts[a:b], buckets, orders)[1], minlength=buckets)
        for lang, counts in total.items():
            used = np.flatnonzero(counts)
            yield pd.DataFrame({"lang": lang, "bucket": np.append(used, -1), "n": np.append(counts[used], docs[lang])})

    sums = rows.mapInPandas(counted, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sums["lang"].unique())
    counts, seen = np.zeros((buckets, len(langs))), np.zeros(len(langs))
    for k, lang in enumerate(langs):
        own = sums[sums["lang"] == lang]
        grams = own[own["bucket"] >= 0]
        counts[grams["bucket"].to_numpy(), k] = grams["n"].to_numpy()
        seen[k] = own.loc[own["bucket"] < 0, "n"].sum()
    log_prob = np.log(counts + smoothing) - np.log(counts.sum(0) + smoothing * buckets)
    return LanguageModel(langs, log_prob.astype(np.float32), np.log(np.maximum(seen, 1) / max(seen.sum(), 1)), buckets, orders)


def identify_language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """docs with lang_pred (one of the model's languages, or `und`) and score, the posterior of lang_pred.

    A text that is null or has no letter gets `und` and 0.0. The log-likelihood of a text is the sum of the rows of the
    log-probability matrix at its n-grams, taken for a batch of texts at a time. Ties go to the language first by name.
    Columns of docs named lang_pred or score are replaced; the others stay as they are.
    """
    spark = docs.sparkSession
    short_batches(spark)
    shared = spark.sparkContext.broadcast((model.langs, model.log_prob, model.log_prior, model.buckets, model.orders))

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, log_prob, log_prior, n_buckets, orders = shared.value
        for series in batches:
            texts = [t or "" for t in series]
            pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for a, b in blocks_of(texts) if langs else ():
                of, buckets = _grams(texts[a:b], n_buckets, orders)
                ll = np.stack([np.bincount(of, weights=log_prob[buckets, k], minlength=b - a) for k in range(len(langs))], 1)
                ll += log_prior
                best = ll.argmax(1)
                posterior = 1 / np.exp(ll - ll.max(1, keepdims=True)).sum(1)
                for i, t in enumerate(texts[a:b]):
                    if any(map(str.isalpha, t)):
                        pred[a + i], score[a + i] = langs[best[i]], posterior[i]
            yield pd.DataFrame({"lang_pred": pred, "score": score})

    clean = docs.drop("lang_pred", "score")
    return clean.select(F.struct("*").alias("row"), predict(F.col(text_col)).alias("found")).select("row.*", "found.*")
