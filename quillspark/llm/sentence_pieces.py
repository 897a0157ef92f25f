"""SentencePiece BPE encoding that keeps offsets, and decoding: every piece is known by its bytes in the source text.

A text is normalised by the longest prefixes that the model's compiled character map knows; each normalised character
records where in the source its prefix began, so that any run of normalised characters, and thus any piece, projects to
a span of source bytes. Pieces are made by merges between places that no piece of the vocabulary crosses.
"""

from __future__ import annotations

import heapq
import re
import struct
from array import array
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import short_batches

SPACE = "▁"  # stands for a blank in pieces
# kinds of pieces in a model's file
_NORMAL, _UNKNOWN, _CONTROL, _USER, _UNUSED, _BYTE = range(1, 7)


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and values of one protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + n]
        at += n


class CharacterMap:
    """A compiled character map: a double-array trie over UTF-8 prefixes, and the replacements, each ended by a zero byte.

    File layout: length of the trie in bytes (32 bits), its units of 32 bits, replacements. A unit holds the offset of its
    children from bit 10 on (bit 9: shifted by 8), bit 8 tells that a child ends a key, and the low byte is the label.
    """

    def __init__(self, blob: bytes):
        n = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = struct.unpack_from(f"<{n // 4}I", blob, 4) if n else ()
        self.texts = blob[4 + n :]
        firsts = [b for b in range(256) if self._child(self._offset(0), b) is not None] if n else []
        # characters whose first byte begins a key; all others stand for themselves
        self.starts = firsts
        ascii_ = "".join(re.escape(chr(b)) for b in firsts if 0 < b < 128)
        wide = [f"{chr(lo)}-{chr(hi)}" for b in firsts if b >= 0xC2 for lo, hi in [self._range(b)]]
        self.touched = re.compile(f"[{ascii_}{''.join(wide)}]") if ascii_ or wide else None

    @staticmethod
    def _range(lead: int) -> tuple[int, int]:
        """First and last code point whose UTF-8 begins with this byte."""
        if lead < 0xE0:
            return (lead & 31) << 6, (lead & 31) << 6 | 63
        if lead < 0xF0:
            return max(0x800, (lead & 15) << 12), (lead & 15) << 12 | 0xFFF
        return max(0x10000, (lead & 7) << 18), min(0x10FFFF, (lead & 7) << 18 | 0x3FFFF)

    def _offset(self, place: int) -> int:
        unit = self.units[place]
        return place ^ (unit >> 10) << ((unit & 1 << 9) >> 6)

    def _child(self, base: int, byte: int) -> int | None:
        place = base ^ byte
        return place if place < len(self.units) and self.units[place] & ((1 << 31) | 0xFF) == byte else None

    def longest(self, raw: bytes, at: int) -> tuple[int, str] | None:
        """Length of the longest key that raw begins with at a place, and what replaces it."""
        base, found = self._offset(0), None
        for k in range(at, len(raw)):
            place = self._child(base, raw[k])
            if place is None:
                break
            base = self._offset(place)
            if self.units[place] >> 8 & 1:
                found = (k + 1 - at, self.units[base] & (1 << 31) - 1)
        if found is None:
            return None
        text = self.texts[found[1] : self.texts.index(b"\0", found[1])]
        return found[0], text.decode("utf-8")


def _widths(text: str) -> np.ndarray:
    """UTF-8 bytes of each character."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)


class Normaliser:
    """Text to normalised text with, for each of its characters, the source byte where it begins, and one entry for the end.

    Blanks and the sign that stands for them are one character from here on, `space`.
    """

    def __init__(self, blob: bytes, dummy_prefix: bool, squeeze: bool, suffix: bool, space: str = SPACE):
        self.map = CharacterMap(blob)
        self.dummy_prefix, self.squeeze, self.suffix, self.space = dummy_prefix, squeeze, suffix, space

    def _runs(self, text: str, most: int) -> Iterator[tuple[str, np.ndarray, int]]:
        """Replaced text in runs: characters, source bytes where they begin (from the text's start), and the end."""
        touched, at, place = self.map.touched, 0, 0
        while at < len(text):
            hit = touched.search(text, at) if touched else None
            end = min(hit.start() if hit else len(text), at + most)
            if end > at:
                part = text[at:end]
                widths = _widths(part)
                ends = np.cumsum(widths)
                yield part, place + ends - widths, place + int(ends[-1])
                at, place = end, place + int(ends[-1])
                continue
            end = len(text)
            raw = text[at : at + 64].encode("utf-8", "surrogatepass")  # keys are a few characters long
            found = self.map.longest(raw, 0)
            if found is None:
                n, new = len(text[at].encode("utf-8", "surrogatepass")), text[at]
            else:
                n, new = found
            yield new, np.full(len(new), place), place + n
            at += len(raw[:n].decode("utf-8", "surrogatepass"))
            place += n

    def pieces(self, text: str, most: int = 1 << 16) -> Iterator[tuple[str, np.ndarray]]:
        """Normalised text in parts of some `most` characters, cut before the first blank after another character."""
        space, held, begins = self.space, [], []
        first, n, end, blank_before, waits = True, 0, 0, True, []
        for part, places, stop in self._runs(text, most):
            if self.squeeze:
                part, places, blank_before = self._squeezed(part, places, blank_before, waits)
            part = part.replace(" ", space).replace(SPACE, space)
            if not part:
                continue
            end = stop
            if first and self.dummy_prefix and not self.suffix:
                part, places = space + part, np.concatenate((places[:1], places))
            first = False
            if n >= most and (cut := self._border(held[-1], part)) >= 0:
                held.append(part[:cut])
                begins.append(places[:cut])
                yield "".join(held), np.concatenate([*begins, [int(places[cut])]])
                part, places, held, begins, n = part[cut:], places[cut:], [], [], 0
            held.append(part)
            begins.append(places)
            n += len(part)
        if waits:
            end = waits[0][1]
        if first:
            return
        if self.suffix and self.dummy_prefix:
            held.append(space)
            begins.append(np.array([end]))
        yield "".join(held), np.concatenate([*begins, [end]])

    def _border(self, before: str, part: str) -> int:
        """Where part may be cut: at a blank that follows another character; -1 for nowhere."""
        k = part.find(self.space)
        while k >= 0:
            if (part[k - 1] if k else before[-1:]) != self.space:
                return k
            k = part.find(self.space, k + 1)
        return -1

    def _squeezed(self, part: str, places: np.ndarray, blank_before: bool, waits: list[tuple[str, int]]) -> tuple[str, np.ndarray, bool]:
        """Without blanks that follow blanks or stand first; those that may stand last, and signs for blanks, are in waits."""
        chars, own = [], []
        for c, p in zip(part, places.tolist(), strict=True):
            if c == " " and blank_before:
                continue
            blank_before = c == " "
            if c == " " or c == SPACE:
                waits.append((c, p))
                continue
            for w, q in waits:
                chars.append(w)
                own.append(q)
            waits.clear()
            chars.append(c)
            own.append(p)
        return "".join(chars), np.array(own, np.int64), blank_before


class PieceModel:
    """A BPE model's pieces, merges between them, and what its file says of normalising and decoding."""

    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        trainer: dict[int, int | bytes] = {}
        norm: dict[int, int | bytes] = {}
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                piece, kind = own[1].decode("utf-8"), own.get(3, _NORMAL)
                self.ids[piece.replace(SPACE, " ")] = len(self.pieces)
                if kind == _NORMAL:
                    self.scores[piece.replace(SPACE, " ")] = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
                self.pieces.append(piece)
                self.kinds.append(kind)
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("not a BPE model")
        if _USER in self.kinds or _UNUSED in self.kinds:
            raise ValueError("user-defined and unused pieces are not supported")
        self.unknown = self.kinds.index(_UNKNOWN)
        self.unknown_text = trainer.get(44, " ⁇ ".encode()).decode("utf-8")
        self.fallback = bool(trainer.get(35, 0))
        self.bytes = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _BYTE}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        spoken = {_CONTROL: "", _UNKNOWN: self.unknown_text, _BYTE: None}
        self.numerals = list(map(str, range(len(self.pieces))))
        self.texts = [spoken.get(k, p.replace(SPACE, " ")) for p, k in zip(self.pieces, self.kinds, strict=True)]  # None: a byte
        self.prefix, self.squeeze = bool(norm.get(3, 1)), bool(norm.get(4, 1))
        self.suffix = bool(trainer.get(24, 0))
        if not norm.get(5, 1):
            raise ValueError("models that tell blanks from their sign are not supported")
        # inside, a blank stands for its sign: texts of one byte a character stay that
        self.normaliser = Normaliser(bytes(norm.get(2, b"")), self.prefix, self.squeeze, self.suffix, " ")

    @classmethod
    def read(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            return cls(f.read())


class Merges:
    """The vocabulary's merges as arrays, for the pieces of many words at once: a step makes the best merge of every word.

    Merges are numbered from the best score on, so that the least number of a word is its next merge. Pieces that share a
    score have no such order among themselves; words that hold one of them are merged one by one.
    """

    def __init__(self, model: PieceModel, longest: int = 48):
        self.model, self.longest = model, longest
        scores = model.scores
        symbols = list(dict.fromkeys([*scores, *(c for p in scores for c in p)]))
        number = {p: k for k, p in enumerate(symbols)}
        found = [(-x, number[p], number[p[:k]] * len(symbols) + number[p[k:]]) for p, x in scores.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        by_score = np.array([f[1:] for f in sorted(found)], np.int64).reshape(-1, 2)
        order = np.argsort(by_score[:, 1], kind="stable")
        self.n, self.none = len(symbols), len(by_score)
        self.keys, self.place = by_score[order, 1], order.astype(np.int32)
        self.to = np.append(by_score[:, 0], -1).astype(np.int32)
        times = Counter(x for p, x in scores.items() if len(p) > 1)
        tied = sorted(p for p, x in scores.items() if len(p) > 1 and times[x] > 1)
        self.tied = re.compile("|".join(map(re.escape, tied))) if tied else None
        self.of_char = np.full(0x110000, -1, np.int32)
        for c, k in number.items():
            if len(c) == 1:
                self.of_char[ord(c)] = k
        # of a symbol: its id and, in the upper half, its characters; 0 if the vocabulary has it only inside of pieces
        self.value = np.array([model.ids[p] | len(p) << 32 if p in model.ids else 0 for p in symbols], np.uint64)

    def _pair(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Number of the merge of symbols a and b, `none` if there is none; no symbol is -1."""
        if not self.none:
            return np.zeros(a.shape, np.int32)
        key = a.astype(np.int64) * self.n + b
        at = np.minimum(np.searchsorted(self.keys, key), self.none - 1)
        return np.where((self.keys[at] == key) & (a >= 0) & (b >= 0), self.place[at], np.int32(self.none))

    def _merged(self, symbols: np.ndarray) -> np.ndarray:
        """Rows of symbols, -1 behind the last, with all merges made."""
        out, left = symbols.copy(), np.arange(len(symbols))
        width = symbols.shape[1]
        pairs = self._pair(symbols[:, :-1], symbols[:, 1:])
        columns = np.arange(width - 1)
        while len(left) and width > 1:
            at = pairs.argmin(1)
            rows = np.arange(len(left))
            merge = pairs[rows, at]
            open_ = merge < self.none
            if not open_.all():
                out[left[~open_]] = symbols[~open_]
                left, symbols, pairs, at, merge = left[open_], symbols[open_], pairs[open_], at[open_], merge[open_]
                rows = rows[: len(left)]
            if not len(left):
                break
            new = self.to[merge]
            symbols[:, :-1] = np.where(columns > at[:, None], symbols[:, 1:], symbols[:, :-1])
            symbols[:, -1] = -1
            symbols[rows, at] = new
            pairs[:, :-1] = np.where(columns[:-1] >= at[:, None], pairs[:, 1:], pairs[:, :-1])
            pairs[:, -1] = self.none
            # the pairs on both sides of what was merged
            ahead = at < width - 1
            pairs[rows[ahead], at[ahead]] = self._pair(new[ahead], symbols[rows[ahead], at[ahead] + 1])
            behind = at > 0
            pairs[rows[behind], at[behind] - 1] = self._pair(symbols[rows[behind], at[behind] - 1], new[behind])
        return out

    def pieces(self, words: list[str]) -> list[bytes]:
        """Of each word its pieces: 64 bits each, the id and, in the upper half, how many characters it takes."""
        out: list[bytes | None] = [None] * len(words)
        lengths = np.array(list(map(len, words)), np.int64)
        if self.tied:
            lengths[[i for i, w in enumerate(words) if self.tied.search(w)]] = self.longest + 1
        low = 0
        for high in (2, 4, 6, 8, 10, 13, 18, 28, self.longest):
            which = np.flatnonzero((lengths > low) & (lengths <= high))
            for k in range(0, len(which), 1 << 13):
                own = which[k : k + (1 << 13)]
                points = np.frombuffer("".join([words[i] for i in own.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4")
                inside = np.arange(high) < lengths[own][:, None]
                symbols = np.full((len(own), high), -1, np.int32)
                symbols[inside] = self.of_char[points]
                plain = (symbols >= 0).sum(1) == lengths[own]
                done = self._merged(symbols[plain])
                used = done >= 0
                values = np.where(used, self.value[done], 0)
                odd = ((values == 0) & used).any(1)
                ends = 8 * np.cumsum(used.sum(1))
                flat, start = values[used].tobytes(), 0
                for i, end, rare in zip(own[plain].tolist(), ends.tolist(), odd.tolist(), strict=True):
                    if not rare:
                        out[i] = flat[start:end]
                    start = end
            low = high
        return [self._single(w) if x is None else x for w, x in zip(words, out, strict=True)]

    def _single(self, word: str) -> bytes:
        """pieces() of one word that is long, or has characters that are no piece."""
        model, out = self.model, []
        for piece in self._long(word):
            i = model.ids.get(piece, model.unknown)
            if i == model.unknown and model.fallback:
                out += [model.bytes[b] for b in piece.replace(" ", SPACE).encode("utf-8", "surrogatepass")]
                out[-1] |= len(piece) << 32  # the last byte stands for the character
            else:
                out.append(i | len(piece) << 32)
        return array("Q", out).tobytes()

    def _long(self, word: str) -> list[str]:
        """Pieces of a word of any length: merges wait in a heap."""
        scores, parts = self.model.scores, list(word)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(-scores[a + b], i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in scores]
        heapq.heapify(heap)
        while heap:
            _, i, joined = heapq.heappop(heap)
            j = after[i]
            if not parts[i] or j >= len(parts) or parts[i] + parts[j] != joined:
                continue  # one of the two has gone into another piece
            parts[i], parts[j] = joined, ""
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
            for a, b in ((before[i], i), (i, k)):
                if a >= 0 and b < len(parts) and (new := parts[a] + parts[b]) in scores:
                    heapq.heappush(heap, (-scores[new], a, new))
        return [p for p in parts if p]


class PieceEncoder:
    """Turns texts into ids and the borders of their pieces in source bytes; a bounded cache holds what stands between blanks."""

    def __init__(self, model: PieceModel, cache_size: int = 500_000):
        self.model, self.merges = model, Merges(model)
        joined = sorted({c for p in model.scores if len(p) > 1 for c in p} - {" "})
        inside = f"[{''.join(map(re.escape, joined))}]" if joined else r"(?!)"
        # no piece crosses from these on: characters that only stand alone, and a blank after anything but blanks
        crossed = any(" " in p.lstrip(" ") for p in model.scores)
        self.words = re.compile(f"(?:{inside}| )+|." if crossed else f" +{inside}*|{inside}+|.", re.DOTALL)
        self.chunks = self.words if crossed else re.compile(" *[^ ]+| +")
        self.cache: dict[str, bytes] = {}
        self.cache_size = cache_size

    def _learn(self, chunks: list[str]) -> None:
        """Pieces of chunks that the cache lacks; their words are merged all at once."""
        split = list(map(self.words.findall, chunks))
        words = list(set().union(*split))
        known = dict(zip(words, self.merges.pieces(words), strict=True))
        of = known.__getitem__
        self.cache.update(zip(chunks, [of(own[0]) if len(own) == 1 else b"".join(map(of, own)) for own in split], strict=True))

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """Of each text its ids, and borders: source bytes where the pieces begin and, last, where they end (64 bits each; none without pieces)."""
        out: list[tuple[list[bytes], list[bytes]]] = [([], []) for _ in texts]
        held: list[tuple[int, list[str], np.ndarray]] = []
        size = 0
        for k, text in enumerate(texts):
            for part, places in self.model.normaliser.pieces(text):
                held.append((k, self.chunks.findall(part), places))
                size += len(part)
                if size >= 1 << 20:
                    self._flush(held, out)
                    held, size = [], 0
        self._flush(held, out)
        return [(b"".join(ids), b"".join(borders)) for ids, borders in out]

    def _flush(self, held: list[tuple[int, list[str], np.ndarray]], out: list[tuple[list[bytes], list[bytes]]]) -> None:
        every = set().union(*(chunks for _, chunks, _ in held))
        new = every.difference(self.cache)
        if len(self.cache) + len(new) > self.cache_size and self.cache:
            self.cache.clear()
            new = every
        self._learn(list(new))
        known = self.cache.__getitem__
        for k, chunks, places in held:
            found = np.frombuffer(b"".join(map(known, chunks)), np.uint64)
            own, ends = (found & np.uint64(0xFFFFFFFF)).astype("<u4"), np.cumsum((found >> np.uint64(32)).astype(np.int64))
            ids, borders = out[k]
            if not self.model.fallback:
                alone = np.concatenate(([True], (own[1:] != self.model.unknown) | (own[:-1] != self.model.unknown)))  # unknown pieces in a row are one
                own, ends = own[alone], ends[np.concatenate((alone[1:], [True]))]
            if not borders:
                borders.append(places[:1].astype("<i8").tobytes())
            ids.append(own.tobytes())
            borders.append(places[ends].astype("<i8").tobytes())
        for chunk in [c for c in new if len(c) > 64]:
            del self.cache[chunk]


class PieceDecoder:
    """Turns ids into text as they come: blanks for their signs, bytes into characters, none of control pieces."""

    def __init__(self, model: PieceModel):
        self.model, self.raw, self.first, self.any = model, bytearray(), True, False
        self.texts, self.byte_of = model.texts, model.byte_of

    @staticmethod
    def _utf8(raw: bytes) -> str:
        """Bytes as text; each byte that is part of no character is replaced by itself."""
        out, at = [], 0
        while at < len(raw):
            lead = raw[at]
            n = 1 if lead < 0x80 else 2 if 0xC2 <= lead < 0xE0 else 3 if 0xE0 <= lead < 0xF0 else 4 if 0xF0 <= lead < 0xF5 else 0
            try:
                out.append(raw[at : at + max(n, 1)].decode("utf-8"))
                at += max(n, 1)
            except UnicodeDecodeError:
                out.append("�")
                at += 1
        return "".join(out)

    def _bytes(self) -> str:
        text = self._utf8(bytes(self.raw)) if self.raw else ""
        self.raw.clear()
        return text

    def feed(self, ids: list[int]) -> str:
        if not self.first and not self.raw:
            plain = [self.texts[i] for i in ids]
            if None not in plain:
                return "".join(plain)
        out = []
        for i in ids:
            text = self.texts[i]
            if text is None:
                self.raw.append(self.byte_of[i])
                continue
            if self.raw:
                out.append(self._bytes())
            if self.first:
                before = bool(out) and any(out)
                if before or self.any:
                    self.first = False
                elif self.model.kinds[i] == _NORMAL and (self.model.prefix or self.model.squeeze) and text.startswith(" "):
                    text = text[1:]
                    self.any = not self.model.squeeze
                self.first = self.first and not text
            out.append(text)
        return "".join(out)

    def close(self) -> str:
        return self._bytes()


def piece_encode(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str = "ids", borders_col: str = "borders") -> DataFrame:
    """docs with ids_col (little-endian unsigned 32-bit integers) and borders_col (signed 64-bit: the source byte where each
    piece begins and, last, the end of the last; piece k is the bytes from border k to border k + 1). Both are binary.

    Null texts count as empty; they have no ids and no borders. Columns with these names are replaced, all others stay.
    Every row is encoded by itself, in parts of some 64 K characters: copies, ties and hot keys need no care. No rows give no rows.
    """
    spark = docs.sparkSession
    short_batches(spark)
    with open(model_path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())  # the model's file, of fixed size

    @F.pandas_udf("ids binary, borders binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = PieceEncoder(PieceModel(sent.value))
        for series in batches:
            yield pd.DataFrame(encoder.encode([t or "" for t in series]), columns=["ids", "borders"], dtype=object)

    free = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in docs.columns)) + "pieces"
    return docs.withColumn(free, encode(F.col(text_col))).withColumns({ids_col: F.col(free)["ids"], borders_col: F.col(free)["borders"]}).drop(free)


def piece_decode(rows: DataFrame, model_path: str, ids_col: str = "ids", text_col: str = "decoded", listed_col: str | None = None) -> DataFrame:
    """rows with text_col: the text of ids_col (as piece_encode writes it), and with listed_col: the ids in decimal, joined by commas.

    Null ids give empty texts. Columns with these names are replaced, all others stay.
    """
    spark = rows.sparkSession
    with open(model_path, "rb") as f:
        sent = spark.sparkContext.broadcast(f.read())

    @F.pandas_udf("decoded string, listed string")
    def decode(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = PieceModel(sent.value)
        for series in batches:
            out = []
            for raw in series:
                machine, ids = PieceDecoder(model), np.frombuffer(raw or b"", "<u4").tolist()
                text = "".join([machine.feed(ids[k : k + 4096]) for k in range(0, len(ids), 4096)]) + machine.close()
                out.append((text, ",".join(map(model.numerals.__getitem__, ids)) if listed_col else None))
            yield pd.DataFrame(out, columns=["decoded", "listed"], dtype=object)

    free = "_" * (1 + max(len(c) - len(c.lstrip("_")) for c in rows.columns)) + "pieces"
    told = {text_col: F.col(free)["decoded"]} | ({listed_col: F.col(free)["listed"]} if listed_col else {})
    return rows.withColumn(free, decode(F.col(ids_col))).withColumns(told).drop(free)
