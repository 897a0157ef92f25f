"""Personal data: base patterns, and information-theoretic sanitisation of the terms that give protected entities away."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import cut, hash_filter, maybe_in, short_batches

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{2,}")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches as a leftmost search finds them, from one @ to the next, so that long runs cost no restarts."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """Spans of each kind in code points, end exclusive: leftmost, non-overlapping, failing matches dropped for good."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if "@" in text:
        found["email"] = list(_emails(text))
    if "." in text:
        for m in _DOTTED.finditer(text):
            parts, start = m.group().split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = start + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                    found["ip"].append((start, end))
                start = end + 1
    for m in _DIGITS.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and _luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m.group())) <= 15:
                found["phone"].append(m.span())
    return found


def _term_hash(term: str) -> int:
    """The value of Spark's own xxhash64 for a string."""
    h = xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass"), seed=42)
    return h - (1 << 64) if h >> 63 else h


def _owner(kind: str, literal: str) -> str:
    """What mentions of one owner share: the domain of an address, a network of 256, a card's issuer, a number's area."""
    return {"email": literal.rpartition("@")[2], "ip": literal.rpartition(".")[0], "card": literal[:6], "phone": literal[:6]}[kind]


def find_base(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """Per document the base spans, and for each mention of a protected entity its context: the terms around it.

    Each mention stands for three entities: the literal, its owner and its kind. A further one, with all terms of the
    text as its context, is the document that holds personal data.
    """
    short_batches(docs.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, spans, mentions = [], [], []
            for i, text in zip(batch["id"], batch["text"], strict=True):
                text = text or ""
                found, near = base_spans(text), []
                blank = _blanked(text, sorted(s for own in found.values() for s in own)) if any(found.values()) else ""
                places = list(_TERM.finditer(blank))
                starts, ends = [m.start() for m in places], [m.end() for m in places]
                for kind in KINDS:
                    for a, b in found[kind]:
                        # the nearest whole words however far off; what is itself protected is no term
                        low, high = _word_edges(text, blank, a, b)
                        k, n = bisect_right(ends, low), bisect_left(starts, high)
                        left = [m.group().lower() for m in places[max(0, k - window) : k]]
                        right = [m.group().lower() for m in places[n : n + window]]
                        if left or right:
                            literal = re.sub(r"[ ().-]", "", text[a:b].lower()) if kind in ("card", "phone") else text[a:b].lower()
                            context, terms = _term_hash(" ".join([*left, "|", *right])), sorted({*left, *right})
                            for entity in (f"{kind}:{literal}", f"owner:{kind}:{_owner(kind, literal)}", f"kind:{kind}"):
                                near.append({"entity": _term_hash(entity), "pooled": not entity.startswith(kind), "context": context, "terms": terms})
                if places:
                    near.append({"entity": _term_hash("document"), "pooled": True, "context": _term_hash(text), "terms": sorted({m.group().lower() for m in places})})
                ids.append(i)
                spans.append([{"kind": k, "start": a, "end": b} for k in KINDS for a, b in found[k]])
                mentions.append(near)
            yield pd.DataFrame({"id": ids, "spans": spans, "mentions": mentions})

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInPandas(scan, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>, mentions array<struct<entity:long,pooled:boolean,context:long,terms:array<string>>>")


def _blanked(text: str, taken: list[tuple[int, int]]) -> str:
    """text, at its length, with protected spans (in order) blanked out."""
    out, at = [], 0
    for s, e in taken:
        if e > at:
            s = max(s, at)
            out += [text[at:s], " " * (e - s)]
            at = e
    return "".join([*out, text[at:]])


def _word_edges(text: str, blank: str, a: int, b: int) -> tuple[int, int]:
    """a and b moved outwards over the rest of a word that the span cuts in two."""
    if text[a].isalnum():
        while a and (blank[a - 1].isalnum() or blank[a - 1] == "_"):
            a -= 1
    if text[b - 1].isalnum():
        while b < len(blank) and (blank[b].isalnum() or blank[b] == "_"):
            b += 1
    return a, b


def _at_least(n):
    """Lower 95 % bound of a count's expectation, by the cube-root approximation of the Poisson law."""
    return n * F.pow(1 - 1 / (9 * n) - 1.645 / (3 * F.sqrt(n)), F.lit(3.0))


def _bitmap(keys: DataFrame, bits: int) -> dict[int, bytes]:
    rows = keys.select(F.pmod("hash", F.lit(bits)).alias("s")).groupBy(F.expr("s div 32768").alias("bucket")).agg(F.bitmap_construct_agg(F.col("s") % 32768).alias("bits")).collect()
    return {r["bucket"]: bytes(r["bits"]) for r in rows}


def _candidates(texts: pd.Series, bitmap: dict[int, bytes], bits: int, known: dict[str, int]) -> Iterator[list[tuple[int, int, int]]]:
    """For each text (hash, start, end) of its terms that the bitmap may hold; known: hashes (0: not in it) so far."""
    for text in texts:
        out = []
        for m in _TERM.finditer(text or ""):
            term = m.group().lower()
            h = known.get(term)
            if h is None:
                h = _term_hash(term)
                s = h % bits
                hit = bitmap.get(s // 32768)
                h = h if hit is not None and hit[s % 32768 // 8] >> (s % 8) & 1 else 0
                if len(known) > 200_000:
                    known.clear()
                known[term] = h
            if h:
                out.append((h, m.start(), m.end()))
        yield out


def different_texts(docs: DataFrame, text_col: str) -> DataFrame:
    """text: each different text once. Only texts that may occur again are shuffled, combined where they lie."""
    keyed = docs.select(F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    again = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    told = maybe_in(keyed, F.col("key"), cut(hash_filter(again, F.col("key"))), "_again")
    return told.filter("not _again").select("text").unionByName(told.filter("_again").groupBy("key").agg(F.first("text").alias("text")).select("text"))


def disclosing_terms(mentions: DataFrame, docs: DataFrame, text_col: str, disclosure: float) -> DataFrame:
    """Terms (hash and text) that reveal an entity: PMI(term; entity) >= disclosure * IC(entity).

    mentions: entity, pooled, context, terms. Probabilities are shares of all different texts, so copies of a document count
    once. A term counts for an entity once per different context, so copies of one passage are one piece of evidence. Of
    the common contexts one is left out: a single context of an entity proves nothing, and
    evidence is pooled in its owner, its kind and the documents with personal data. Pooled entities meet so many terms
    by chance that of their common contexts the lower 95 % bound is taken.
    """
    spark = docs.sparkSession
    texts = different_texts(docs, text_col)
    total = F.lit(float(max(1, docs.select(F.xxhash64(text_col).alias("key")).distinct().count())))
    seen = cut(mentions.groupBy("entity", "pooled", "context").agg(F.first("terms").alias("terms")))
    often = cut(seen.groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")))
    pairs = seen.select("entity", "pooled", F.explode("terms").alias("term")).groupBy("entity", "pooled", "term").agg(F.count(F.lit(1)).alias("n_both"))
    # entities with more than a thousandth of all contexts, fewer than a thousand, meet most of the vocabulary: they are broadcast
    most = F.lit((often.agg(F.sum("n_entity")).first()[0] or 0) / 1000)
    hot = F.broadcast(often.filter(F.col("n_entity") > most))
    pairs = pairs.join(hot, "entity").unionByName(pairs.join(hot, "entity", "left_anti").join(often.filter(F.col("n_entity") <= most), "entity"))

    def reveals(n_term):
        content = F.log2(total / F.col("n_entity"))
        return (content > 0) & (F.col("n_both") > 1) & (F.log2(F.when(F.col("pooled"), _at_least(F.col("n_both"))).otherwise(F.col("n_both") - 1) * total / (F.col("n_entity") * n_term)) >= disclosure * content)

    # no term is in fewer texts than in contexts, so most are settled before the texts are counted; all terms are counted,
    # once per task, so that the rows counted grow with the texts and not with the candidates as well
    pairs = cut(pairs.filter(reveals(F.greatest(F.lit(1), F.col("n_both")))).withColumn("hash", F.xxhash64("term")))
    if pairs.isEmpty():
        return pairs.select("hash", "term")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter[str] = Counter()

        def put() -> pd.DataFrame:
            return pd.DataFrame({"hash": [_term_hash(t) for t in counts], "n": list(counts.values())}, dtype="int64")

        for batch in batches:
            for text in batch["text"]:
                counts.update(set(map(str.lower, _TERM.findall(text or ""))))
            if len(counts) > 200_000:
                yield put()
                counts.clear()
        yield put()

    df = texts.mapInPandas(count, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n_term"))
    scored = pairs.join(df, "hash").filter(reveals(F.greatest("n_term", "n_both")))
    return scored.groupBy("hash").agg(F.min("term").alias("term"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 8, disclosure: float = 0.8) -> DataFrame:
    """One row per row of docs: id, spans (an array of (kind, start, end) in code points, by kind and then start), sanitised.

    Base kinds (email, ip, card, phone) come from patterns. Kind `term` comes from the corpus: the terms within `window`
    words of an entity are counted over all documents, copies of a passage once, and a term whose pointwise mutual
    information with a protected entity (see find_base) reaches `disclosure` times the entity's information content gives it away; it is marked
    in every document. sanitised: the text with base spans generalised to their kind and terms removed (see redacted).
    Null or empty texts have no spans and "" as sanitised; repeated rows each get theirs (ids should identify texts: rows
    that share an id share their terms, those past a text's end count for nothing); rows with a null id have base spans only; extra columns are ignored; no rows give no rows.
    """
    base = cut(find_base(docs, id_col, text_col, window))
    mentions = base.select(F.explode("mentions").alias("m")).select("m.*")
    flagged = cut(disclosing_terms(mentions, docs, text_col, disclosure))
    marks = cut(_marked(docs, id_col, text_col, flagged))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    wanted = base.filter(F.size("spans") > 0).select("id").unionByName(marks.select("id"))
    told = maybe_in(rows, F.col("id"), cut(hash_filter(wanted, F.col("id"))), "_hit")
    kinds = "array<struct<kind:string,start:bigint,end:bigint>>"

    @F.pandas_udf(kinds)
    def all_spans(texts: pd.Series, more: pd.Series) -> pd.Series:
        out = []
        for text, own in zip(texts, more, strict=True):
            found = base_spans(text)
            spans = [{"kind": k, "start": a, "end": b} for k in KINDS for a, b in found[k]]
            out.append(spans + [{"kind": "term", "start": x["start"], "end": x["end"]} for x in (() if own is None else own) if x["end"] <= len(text)])
        return pd.Series(out, dtype=object)

    hit = told.filter("_hit").select("id", "text").join(marks, "id", "left").select("id", "text", all_spans("text", "more").alias("spans"))
    hit = redacted(hit).select("id", "spans", "sanitised")
    rest = told.filter("not _hit").select("id", F.array().cast(kinds).alias("spans"), F.col("text").alias("sanitised"))
    return hit.unionByName(rest).withColumnRenamed("id", id_col)


def _marked(docs: DataFrame, id_col: str, text_col: str, flagged: DataFrame, bits: int = 1 << 22) -> DataFrame:
    """id and more, the places of flagged terms: candidates pass a bitmap of fixed size, a join on the hash settles them."""
    kind = docs.schema[id_col].dataType.simpleString()
    bitmap = _bitmap(flagged, bits)
    if not bitmap:
        return docs.sparkSession.createDataFrame([], f"id {kind}, more array<struct<start:bigint,end:bigint>>")
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for batch in batches:
            found = [(i, *x) for i, own in zip(batch["id"], _candidates(batch["text"], shared.value, bits, known), strict=True) for x in own]
            yield pd.DataFrame(found, columns=["id", "hash", "start", "end"])

    places = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null").mapInPandas(find, f"id {kind}, hash long, start long, end long")
    hits = places.join(flagged.select("hash"), "hash", "left_semi")
    return hits.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("more"))


def redacted(rows: DataFrame, text_col: str = "text", spans_col: str = "spans", out_col: str = "sanitised") -> DataFrame:
    """rows with out_col: base spans generalised to their kind in brackets, terms removed; overlaps go to the first span."""

    @F.pandas_udf("string")
    def cover(texts: pd.Series, spans: pd.Series) -> pd.Series:
        done = []
        for text, own in zip(texts, spans, strict=True):
            text, out, at = text or "", [], 0
            for s in sorted(() if own is None else own, key=lambda s: (s["start"], -s["end"])):
                if s["start"] >= at:
                    out += [text[at : s["start"]], "" if s["kind"] == "term" else f"[{s['kind'].upper()}]"]
                    at = s["end"]
            done.append("".join(out) + text[at:])
        return pd.Series(done)

    return rows.withColumn(out_col, cover(F.col(text_col), F.col(spans_col)))
