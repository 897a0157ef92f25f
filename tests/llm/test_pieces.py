"""SentencePiece encoding, offsets, normalising and decoding against the sentencepiece library."""

import hashlib
import random
import struct

import numpy as np
import pytest
import sentencepiece

from quillspark.llm import queries
from quillspark.llm.sentence_pieces import Normaliser, PieceDecoder, PieceEncoder, PieceModel, _fields, piece_decode, piece_encode

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "  a", "a  ", "\n\n x\ty", "▁a ▁▁b", "日本語 テキスト", "🙂🙂 é é", "x" * 5000, "ab" * 3000, " " * 300, "<s>a</s><unk>", "\x00\x01", "a b", "<0x41>", "!!!???...", "aa" * 100 + " " + "aa" * 50,
    "word " * 30_000, "x" * 70_000 + " y" * 3,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model_path())


@pytest.fixture(scope="module")
def model():
    return PieceModel.read(queries.piece_model_path())


def numbers(raw, code="I"):
    return [i for (i,) in struct.iter_unpack(f"<{code}", raw)]


def test_ids_and_spans_match_library(library, model):
    rng, encoder = random.Random(7), PieceEncoder(model, cache_size=50)
    parts = ["a", "b", " ", "▁", "é", "日", "the", "ing", "\n", "1", "9", ".", "..", "🙂", "\x00", "ا", "ll", " t", "  "]
    texts = [*ODD, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 150))) for _ in range(500))]
    for text, (ids, borders) in zip(texts, encoder.encode(texts), strict=True):
        assert numbers(ids) == library.encode(text), text[:80]
        at = numbers(borders, "q")
        assert list(zip(at, at[1:], strict=False)) == [(p.begin, p.end) for p in library.encode(text, out_type="proto").pieces], text[:80]


def test_decoding_matches_library_on_any_ids(library, model):
    rng = random.Random(8)
    for _ in range(3000):
        ids = [rng.choice([0, 1, 2, rng.randrange(3, 259), rng.randrange(3, 259), rng.randrange(259, 32_000), 29_871, 0xE2 + 3, 0x96 + 3, 0x81 + 3]) for _ in range(rng.randint(0, 9))]
        machine, step = PieceDecoder(model), rng.randint(1, 4)
        assert "".join(machine.feed(ids[k : k + step]) for k in range(0, len(ids), step)) + machine.close() == library.decode(ids), ids


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nfkc_cf"])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("squeeze", [True, False])
def test_compiled_maps_match_library(rule, prefix, squeeze):
    rng = random.Random(9)
    own = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=prefix, remove_extra_whitespaces=squeeze, escape_whitespaces=True)
    spec = next(dict(_fields(v)) for f, v in _fields(own.serialized_model_proto()) if f == 3)
    normaliser = Normaliser(bytes(spec.get(2, b"")), prefix, squeeze, False)
    pool = "aﬁ①　ｶﾞé ̈é \t\n日ﾊﾟ½ΩÅ각한ㄱㅏ🙂▁ ﷺ​\xadＡＢ．"
    for _ in range(200):
        text = "".join(rng.choice(pool) for _ in range(rng.randint(0, 14)))
        want, offsets = own.normalize(text, with_offsets=True)
        for most in (1 << 16, rng.randint(1, 5)):
            got = list(normaliser.pieces(text, most))
            places = [int(x) for _, own_places in got for x in own_places[:-1]] + ([int(got[-1][1][-1])] if got else [0])
            assert "".join(g[0] for g in got) == want, (text, most)
            assert [len(text.encode()[:p].decode()) for p in places] == offsets, (text, most)


def test_query_matches_library(spark, library):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.op12_sentence_pieces(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_awkward_tables(spark, library):
    rows = [(1, "twice", 1), (1, "twice", 1), (2, None, None), (3, "", 3), (None, " tie", 4), (None, None, 5), (4, "long " * 60_000, 6)]
    docs = spark.createDataFrame([(*r, "x", "y", b"z") for r in rows], "doc_id long, text string, n int, ids string, decoded string, borders binary")
    got = piece_decode(piece_encode(docs, queries.piece_model_path()), queries.piece_model_path())
    assert sorted(got.columns) == sorted(docs.columns)
    for r in got.collect():
        want = library.encode(r["text"] or "")
        assert numbers(r["ids"]) == want and r["decoded"] == library.decode(want)
        assert len(np.frombuffer(r["borders"], "<i8")) == (len(want) + 1 if want else 0)
    assert piece_encode(docs.filter("false"), queries.piece_model_path()).count() == 0
