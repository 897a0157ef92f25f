"""Quality rules: repetition inside a document, from the common-prefix intervals of its suffix array."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import blocks_of, mixed, packed, short_batches, span_hashes, word_bounds
from quillspark.llm.suffix import dense_ranks, lcp_intervals, suffix_array

_COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_maximal_repeats long, longest_repeat long, covered_words long, base_failed boolean, kept boolean"
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


def _sums(per_place: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(per_place)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(keys: np.ndarray) -> np.ndarray:
    """True where a key occurs at least twice."""
    ranks = dense_ranks(keys)
    return np.bincount(ranks, minlength=len(keys))[ranks] > 1


def _measure(texts: list[str | None], min_repeat: int) -> dict[str, np.ndarray]:
    data, starts = packed(texts)
    n = len(texts)
    s, e = word_bounds(data)
    of = np.searchsorted(starts, s, "right") - 1
    first = np.searchsorted(s, starts)  # first word of each text, and the end
    out = {"n_words": np.diff(first)}
    points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    out["word_chars"] = _sums(points[e] - points[s], first)
    out["n_symbols"] = _sums(_SYMBOL[data], starts)

    stop = np.flatnonzero(data == 10)
    begin = np.concatenate(([0], stop[:-1] + 1))
    filled = np.searchsorted(s, stop) > np.searchsorted(s, begin)
    begin, stop = begin[filled], stop[filled]
    line_of = np.searchsorted(starts, begin, "right") - 1
    keys = span_hashes(data, begin, stop, lower=False) ^ mixed(line_of.astype(np.uint64) + np.uint64(1))
    again = np.zeros(len(keys), np.int64)
    ranks = dense_ranks(keys)
    order = np.argsort(ranks, kind="stable")
    again[order[1:]] = ranks[order[1:]] == ranks[order[:-1]]
    out["n_dup_lines"] = np.bincount(line_of, weights=again, minlength=n).astype(np.int64)

    words = span_hashes(data, s, e, lower=False)
    words ^= mixed(of.astype(np.uint64) + np.uint64(1))  # equal words of two texts are different symbols
    m = len(words)
    covered = np.zeros(m, bool)
    if m >= 3:
        grams = mixed(mixed(words[:-2]) * np.uint64(3) + words[1:-1]) * np.uint64(5) + words[2:]
        twice = np.flatnonzero((of[:-2] == of[2:]) & _repeated(mixed(grams)))
        for k in range(3):
            covered[twice + k] = True
    out["n_repeat_words"] = _sums(covered.astype(np.int64), first)

    room = first[of + 1] - np.arange(m)
    array, lcp = suffix_array(dense_ranks(words), room)
    spans, count, longest = np.zeros(m + 1, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    reach = np.maximum(lcp, np.append(lcp[1:], 0))
    at = array[reach >= min_repeat]
    np.add.at(spans, at, 1)
    np.add.at(spans, at + reach[reach >= min_repeat], -1)
    out["covered_words"] = _sums((np.cumsum(spans[:-1]) > 0).astype(np.int64), first)
    before = np.where(array > first[of[array]], words[array - 1], 0) if m else words
    changes = np.concatenate(([0], np.cumsum(before[1:] != before[:-1]))) if m else np.zeros(0, np.int64)
    inside = array == first[of[array]] if m else np.zeros(0, bool)  # a text's first word has nothing before it
    starts_text = np.concatenate(([0], np.cumsum(inside)))
    for left, right, length in lcp_intervals(lcp, min_repeat):
        # maximal: what stands before the occurrences is not one and the same word
        if changes[right] > changes[left] or starts_text[right + 1] > starts_text[left]:
            doc = of[array[left]]
            count[doc] += 1
            longest[doc] = max(longest[doc], length)
    out["n_maximal_repeats"], out["longest_repeat"] = count, longest
    return out


def repetition_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_repeat: int = 8, max_covered: float = 0.3, max_longest: int = 100, min_words: int = 50, max_repeat_share: float = 0.5) -> DataFrame:
    """One row per row of docs with counts, the repeats of its text, base_failed and kept; other columns are left out.

    A text is its words (runs of anything but blank and the controls 9 to 13). A suffix array over the words of each text
    gives the maximal repeated substrings of at least min_repeat words; the union of their spans may cover max_covered of
    the words at most, and none may be longer than max_longest words. base_failed: fewer than min_words words, or more
    than max_repeat_share of the words lie in 3-word windows found twice. Null or blank texts have no words and fail.
    Every text is measured whole, by itself, so hot keys and copies play no part; no rows give no rows.
    """
    short_batches(docs.sparkSession)
    names = [c.split()[0] for c in _COLUMNS.split(", ")]

    @F.pandas_udf(f"struct<{', '.join(c.replace(' ', ':') for c in _COLUMNS.split(', '))}>")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for series in batches:
            texts, parts = [None if t is None else str(t) for t in series], []
            for a, b in blocks_of(texts):
                parts.append(pd.DataFrame(_measure(texts[a:b], min_repeat)))
            x = pd.concat(parts, ignore_index=True)
            x["base_failed"] = (x["n_words"] < min_words) | (x["n_repeat_words"] > max_repeat_share * x["n_words"])
            x["kept"] = ~x["base_failed"] & (x["covered_words"] <= max_covered * x["n_words"]) & (x["longest_repeat"] <= max_longest)
            yield x[names]

    return docs.select(F.col(id_col), measure(F.col(text_col)).alias("_m")).select(F.col(id_col), "_m.*")
