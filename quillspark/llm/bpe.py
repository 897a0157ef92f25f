"""BPE encoding by a transducer with bounded lookahead, and decoding by an incremental state machine."""

from __future__ import annotations

import codecs
import json
import sys
import unicodedata
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import short_batches

# White space as the normaliser understands it, and the word pattern of the vocabulary's file.
_BLANK = "\\t-\\r " + "".join(f"\\u{c:04x}" for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_NOT_BLANK = regex.compile("[\x1c-\x1f]")
_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{_BLANK}\p{{L}}\p{{N}}]+"


def byte_symbols() -> list[str]:
    """The character that stands for each byte: itself if it prints in Latin-1, else the next one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Vocabulary:
    """A merge list with word ends: ids by token, merges by rank, special tokens, and the lookahead that suffices."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.tokens = [""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, i in [*self.ids.items(), *self.special.items()]:
            self.tokens[i] = token
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        tail = len(self.end)
        for rank, (a, b) in enumerate(merges):
            self.merges[self.ids[a], self.ids[b]] = (rank, self.ids[a + b])
        self.length = [len(t) - tail if tail and t.endswith(self.end) else len(t) for t in self.tokens]
        self.lookahead = self._sufficient_lookahead()

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(json.load(f))

    def _sufficient_lookahead(self) -> int:
        """Symbols to the right of a token that can still decide whether it is formed and stays.

        A token (a, b) is prevented only if a token u on its right spine (b, the right part of b, ...) is taken by a
        merge (u, y) of lower rank than the one that takes u here; that depends on the symbols of y and on what y in
        turn depends on. Ranks fall along that chain, so one pass over the merges by rank computes the bound.
        """
        parts: dict[int, tuple[int, int, int]] = {}
        rights: dict[int, tuple[list[int], list[int]]] = {}  # of a left part: ranks, longest reach so far
        reach = [0] * len(self.tokens)
        most = 0
        for (a, b), (rank, token) in sorted(self.merges.items(), key=lambda x: x[1][0]):
            here, u, limit = 0, b, rank
            while True:
                ranks, reaches = rights.get(u, ((), ()))
                if (k := bisect_left(ranks, limit)) > 0:
                    here = max(here, reaches[k - 1])
                if u not in parts:
                    break
                _, u, limit = parts[u]
            parts[token] = (a, b, rank)
            reach[token] = max(reach[token], here)
            ranks, reaches = rights.setdefault(a, ([], []))
            ranks.append(rank)
            reaches.append(max(reaches[-1] if reaches else 0, self.length[b] + reach[b]))
            most = max(most, here, reaches[-1])
        return most

    def join(self, ids: list[int]) -> list[int]:
        """Apply the merges to a short list of ids: always the lowest rank, of equals the leftmost."""
        get, none = self.merges.get, (1 << 60, 0)
        ranks = [get(pair, none) for pair in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best is none:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = get((ids[i - 1], ids[i]), none)
            if i < len(ranks):
                ranks[i] = get((ids[i], ids[i + 1]), none)
        return ids


def _bytes_of(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class OpenWord:
    """A word that arrives in parts: symbols enter a window, and a token leaves once the lookahead behind it is there.

    pattern matches what may follow inside the same word. The last byte waits, as it has another symbol at a word's end.
    """

    def __init__(self, encoder: Encoder, pattern: regex.Pattern):
        self.encoder, self.pattern = encoder, pattern
        self.held, self.pending = b"", []

    def feed(self, text: str) -> list[int]:
        raw = self.held + text.encode("utf-8", "surrogatepass")
        self.held = raw[-1:]
        return self._push(list(map(self.encoder.inner.__getitem__, raw[:-1])), False)

    def close(self) -> list[int]:
        return self._push([self.encoder.final[self.held[0]]], True)

    def _push(self, singles: list[int | None], last: bool) -> list[int]:
        if None in singles:  # a vocabulary without this symbol drops it
            singles = [i for i in singles if i is not None]
        v, window, out, pos = self.encoder.v, self.encoder.window, [], 0
        while last or len(self.pending) + len(singles) - pos >= window:
            take = window - len(self.pending)
            pending = self.pending + singles[pos : pos + take]
            pos += take
            ended, used = last and pos >= len(singles), 0
            for token in v.join(list(pending)):
                reach = used + v.length[token]
                if not ended and reach + v.lookahead > len(pending):
                    break
                out.append(token)
                used = reach
            self.pending = pending[used:]
            if ended:
                return out
        self.pending += singles[pos:]
        return out


class Encoder:
    """Turns a stream of text pieces into ids.

    Memory: one piece and what is held back, one window of symbols and a bounded cache of words. `hold` characters
    without a blank are the most that is held back; then words go on from piece to piece as an OpenWord. Only a run of
    combining marks is held whole, as NFC has to sort it.
    """

    def __init__(self, vocabulary: Vocabulary, cache_size: int = 300_000, hold: int = 1 << 17):
        self.v, self.hold = vocabulary, hold
        symbols = byte_symbols()
        self.inner = [vocabulary.ids.get(c) for c in symbols]
        self.final = [vocabulary.ids.get(c + vocabulary.end) for c in symbols]
        self.words = regex.compile(_WORDS)
        self.blank = regex.compile(rf"[{_BLANK}]+")
        self.last_blank = regex.compile(rf"(?r)[{_BLANK}]")
        self.letters, self.others = regex.compile(r"\p{L}+"), regex.compile(rf"[^{_BLANK}\p{{L}}\p{{N}}]+")
        self.longest_special = max(map(len, vocabulary.special), default=0)
        self.split = regex.compile("|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True)))) if vocabulary.special else None
        self.window = 2 * (vocabulary.lookahead + max(vocabulary.length, default=1)) + 64
        encoder, most = self, cache_size

        class Cache(dict):
            """Ids by text, as bytes; emptied when full, and long texts stay out."""

            def __init__(self, make: Callable[[str], bytes]):
                self.make = make

            def __missing__(self, text: str) -> bytes:
                out = self.make(text)
                if len(text) <= 64:
                    if len(self) >= most:
                        self.clear()
                    self[text] = out
                return out

        of_word = self.of_word = Cache(lambda word: _bytes_of(encoder.word(word))).__getitem__
        self.cache = Cache(lambda chunk: b"".join(map(of_word, encoder.words.findall(chunk))))  # between blanks

    def word(self, word: str) -> list[int]:
        """Ids of one word, which goes through a window if it is long."""
        if len(word) > self.window:
            whole = OpenWord(self, self.words)
            return whole.feed(word) + whole.close()
        raw = word.encode("utf-8", "surrogatepass")
        singles = list(map(self.inner.__getitem__, raw))
        singles[-1] = self.final[raw[-1]]
        if None in singles:
            singles = [i for i in singles if i is not None]
        return self.v.join(singles)

    def _normal(self, text: str) -> str:
        """NFC and lower case; the normaliser's third step, one blank for white space, changes no word and is left out."""
        return unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()

    def _segment(self, text: str) -> bytes:
        """Ids of normalised text."""
        # str.split also parts at these four controls, which the vocabulary takes for symbols
        chunks = self.blank.split(text) if _NOT_BLANK.search(text) else text.split()
        return b"".join(map(self.cache.__getitem__, chunks))

    def encode(self, pieces: Iterable[str]) -> Iterator[bytes]:
        """Ids of the concatenated pieces as little-endian unsigned 32-bit integers, chunk by chunk.

        A piece is held back from its last blank on, as the word there may go on in the next piece; special tokens hold
        no blank and are found before anything is normalised.
        """
        rest, word = "", None
        for piece in pieces:
            rest += piece
            blank = self.last_blank.search(rest)
            if blank and blank.start() > 0:
                out, word = self._part(rest[: blank.start()], word, False)
                yield out
                rest = rest[blank.start() :]
            if len(rest) > self.hold and (at := self._safe_cut(rest)) > 0:
                out, word = self._part(rest[:at], word, True)
                yield out
                rest = rest[at:]
        yield self._part(rest, word, False)[0]

    def _safe_cut(self, text: str) -> int:
        """The last place before which nothing depends on what follows but how the word there goes on; 0 for none.

        What follows must not compose with what precedes, no special token may lie across, and no elision (an apostrophe
        and up to two letters) may be open, unless the apostrophe is inside a run of symbols.
        """
        for at in range(len(text) - max(self.longest_special, 1), 4, -1):
            if unicodedata.category(text[at])[0] == "M" or "\u1160" <= text[at] <= "\u11ff":
                continue
            if "'" in text[at - 3 : at] and not self.others.fullmatch(text, at - 4, at):
                continue
            near = max(at - self.longest_special + 1, 0)
            if self.split is None or not any(m.start() < at < m.end() for m in self.split.finditer(text, near, at + self.longest_special)):
                return at
        return 0

    def _part(self, text: str, word: OpenWord | None, more: bool) -> tuple[bytes, OpenWord | None]:
        """Ids of text after an open word; with `more`, its last word may go on and is returned open."""
        out, at = [], 0
        specials = [] if self.split is None else [(m.start(), m.end(), self.v.special[m.group()]) for m in self.split.finditer(text)]
        for start, end, special in [*specials, (len(text), len(text), None)]:
            segment, goes_on = self._normal(text[at:start]), more and special is None
            at = end
            if word is not None:
                if m := word.pattern.match(segment):
                    out.append(_bytes_of(word.feed(m.group())))
                    segment = segment[m.end() :]
                if segment or not goes_on:
                    out.append(_bytes_of(word.close()))
                    word = None
            if goes_on and segment:
                *whole, tail = self.words.findall(segment)
                out += map(self.of_word, whole)
                pattern = next((p for p in (self.letters, self.others) if p.match(tail)), None)
                if pattern is None:  # a number is a word by itself
                    out.append(self.of_word(tail))
                else:
                    word = OpenWord(self, pattern)
                    out.append(_bytes_of(word.feed(tail)))
            else:
                out.append(self._segment(segment))
            if special is not None:
                out.append(_bytes_of([special]))
        return b"".join(out), word


class Decoder:
    """Turns ids into text as they come.

    joined=True gives what a vocabulary file without a decoder means: token strings with one blank between them.
    joined=False gives bytes back as text: word ends become blanks and incomplete UTF-8 waits for its remaining bytes.
    """

    def __init__(self, vocabulary: Vocabulary, joined: bool = True):
        self.v, self.joined, self.first = vocabulary, joined, True
        self.bytes = {c: b for b, c in enumerate(byte_symbols())}
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        tokens = list(map(self.v.tokens.__getitem__, ids))
        if self.joined:
            lead = "" if self.first or not tokens else " "
            self.first = self.first and not tokens
            return lead + " ".join(tokens)
        out = []
        for t in tokens:
            if t in self.v.special:
                out.append(self.utf8.decode(b"", final=True) + t)
                self.utf8.reset()
                continue
            ends = bool(self.v.end) and t.endswith(self.v.end)
            raw = bytes(self.bytes[c] for c in (t[: -len(self.v.end)] if ends else t))
            out.append(self.utf8.decode(raw + b" " * ends))
        return "".join(out)

    def close(self) -> str:
        return "" if self.joined else self.utf8.decode(b"", final=True)


def _pieces(text: str, size: int = 1 << 16) -> Iterator[str]:
    return (text[k : k + size] for k in range(0, len(text), size))


def bpe_encode(docs: DataFrame, vocabulary_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """docs with ids_col: the ids of each whole text as little-endian unsigned 32-bit integers (binary).

    Null texts count as empty and give no ids. A text is fed in pieces of 64 K characters, so what the encoder holds does
    not grow with it; a word without end goes through a window of fixed size (see Encoder). An existing ids_col is replaced, other columns stay.
    Every row is encoded by itself: copies, ties and hot keys need no care, and no rows give no rows.
    """
    spark = docs.sparkSession
    short_batches(spark)
    with open(vocabulary_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # the vocabulary's file, of fixed size

    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = Encoder(Vocabulary(json.loads(spec.value)))
        for series in batches:
            yield pd.Series([b"".join(encoder.encode(_pieces(t or ""))) for t in series])

    return docs.withColumn(ids_col, encode(F.col(text_col)))


def bpe_decode(rows: DataFrame, vocabulary_path: str, ids_col: str = "ids", text_col: str = "decoded", joined: bool = True) -> DataFrame:
    """rows with text_col: the text of ids_col (as bpe_encode writes it), decoded a few thousand ids at a time.

    Null ids give an empty text. Special tokens are kept. An existing text_col is replaced, other columns stay.
    """
    spark = rows.sparkSession
    with open(vocabulary_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = Vocabulary(json.loads(spec.value))
        for series in batches:
            out = []
            for raw in series:
                machine, ids = Decoder(vocabulary, joined), np.frombuffer(raw or b"", "<u4")
                out.append("".join([machine.feed(ids[k : k + 4096].tolist()) for k in range(0, len(ids), 4096)]) + machine.close())
            yield pd.Series(out)

    return rows.withColumn(text_col, decode(F.col(ids_col)))
