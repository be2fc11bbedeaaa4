"""Ids, files, coder, packing and pieces: exact round trips and comparison with the libraries."""

import collections
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import common, files, id_files, packing, piece_viterbi, range_coder
from tidemark.llm.tokens import Encoder, vocabulary

SF = "/root/testdata/sf0.001"
ODD = ["It's  a \t test x 1234 ½ ²x Größé don't 'S he'LL\r\n\n end  ", "  \nfoo İstanbul ΑΣ. 你好 🙂", "a\x1cb !\x1c! \x85 z", "  lead", "$$$ ###5a%%\n\nx", "a\0b <|endoftext|> c", "éª º µ ß ÿ Āā ņ", "▁ literal ▁▁ mark", "  \n wide"]
EDGES = [(1, None), (2, ""), (None, "no id"), (4, "same text"), (4, "same text"), (5, "long word " * 9000), *[(10 + i, t) for i, t in enumerate(ODD)]]


def documents():
    return duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by 1").fetchall()


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", 7) for i, t in texts], "doc_id long, text string, ids string, start int")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name):
    library = Tokenizer.from_file(vocabulary(name))
    texts = ODD + [t for _, t in documents()[:60]]
    encoder = Encoder(name)
    for text, ids in zip(texts * 2, encoder.encode(texts * 2), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text[:50]
    assert encoder.encode([None, ""]) == [b"", b""]


LIBRARIES = {name: Tokenizer.from_file(vocabulary(name)) for name in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=20) | st.sampled_from(["<|endoftext|>", "<|startoftext|>", " ", "\n"]), max_size=5).map("".join))
def test_encoder_is_the_library_on_any_text(text):
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        encoder = Encoder.of(name)
        assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == LIBRARIES[name].encode(text, add_special_tokens=False).ids


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 70000), max_size=700))
def test_coder_round_trip(ids):
    ids = np.array(ids, np.uint32)
    block = range_coder.encode_block(ids)
    assert (range_coder.decode_block(block)[0] == ids).all()


def test_coder_compresses_resets_and_notices_damage():
    text = np.tile(np.arange(50, dtype=np.uint32), 4000)
    block = range_coder.encode_block(text)
    assert len(block) < len(text) / 3
    both = range_coder.encode_block(text[:999]) + block
    _, end = range_coder.decode_block(both)
    assert (range_coder.decode_block(both, end)[0] == text).all()  # needs no block before it
    for place in (len(block) // 2, len(block) - 9, range_coder.HEAD.size + 3):
        bad = bytearray(block)
        bad[place] ^= 0x41
        with pytest.raises(ValueError):
            range_coder.decode_block(bytes(bad))
    noise = np.random.default_rng(1).integers(0, 60000, 40000).astype(np.uint32)
    assert (range_coder.decode_block(range_coder.encode_block(noise))[0] == noise).all()


def ids_by_hand(texts, name):
    library = Tokenizer.from_file(vocabulary(name))
    return [np.array(library.encode(t or "", add_special_tokens=False).ids + [2], "<u4") for _, t in texts]


@pytest.mark.parametrize("texts", [EDGES, [], documents()], ids=["edges", "empty", "documents"])
def test_id_files(spark, texts):
    made = id_files.write_ids(frame(spark, texts), common.new_path(spark, "ids"))
    got = [tuple(r) for r in id_files.read_ids(spark, made).collect()]
    texts = sorted(texts, key=lambda x: (x[0] is not None, x[0]))
    at, expected = 0, []
    for (i, _), ids in zip(texts, ids_by_hand(texts, "byte_bpe_50k.json"), strict=True):
        expected.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == expected


def test_id_files_give_ids_and_notice_damage(spark):
    texts = documents()[:20]
    made = id_files.write_ids(frame(spark, texts), common.new_path(spark, "ids"))
    got = {r["doc_id"]: bytes(r["ids"]) for r in id_files.read_ids(spark, made, with_ids=True).collect()}
    assert [got[i] for i, _ in texts] == [x.tobytes() for x in ids_by_hand(texts, "byte_bpe_50k.json")]
    uri = made[0][1]
    with files.reading(uri) as f:
        data = bytearray(f.read())
    data[len(data) // 2] ^= 1
    with files.writing(uri) as out:
        out.write(bytes(data))
    with pytest.raises(Exception, match="damaged"):
        id_files.read_ids(spark, made).collect()


def check_packing(texts, pieces, window=4096):
    """Each id in one piece, sequences gapless, no padding; gives the number of sequences."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in pieces:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for (i, _), ids in zip(texts, ids_by_hand(texts, "word_bpe_49k.json"), strict=True):
        if sum(x[0] == i for x in texts) > 1:
            continue
        at = 0
        for r in sorted(by_doc.pop(i), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : at].tobytes())
        assert at == len(ids)
    for rows in by_sequence.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == window or at < window and at & (at - 1) == 0
    return len(by_sequence)


@pytest.mark.parametrize("texts", [EDGES, [], documents()], ids=["edges", "empty", "documents"])
def test_packing(spark, texts):
    check_packing(texts, packing.pack(frame(spark, texts)).collect())


def test_packing_takes_the_level_of_least_squares():
    out = []
    packer = packing.Packer(16, lambda *a: out.append(a))
    for i, n in enumerate([10, 10, 3, 6, 6]):
        packer.add(i, bytes(4 * n))
    # Two windows at 10; 3 goes onto one of them (13) for that splits a pair; 6 fills the other and needs a new window next.
    assert [(a[0], a[4], a[5]) for a in out] == [(0, 0, 0), (3, 0, 10)] or [(a[0], a[5]) for a in out] == [(1, 0), (3, 10)]
    packer.finish()
    assert sum(len(a[2]) // 4 for a in out) == 35


def test_pieces_are_the_library_and_come_back(spark):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    pieces = piece_viterbi.Pieces.of("piece_bpe_32k.model")
    proto = sentencepiece_model_pb2.ModelProto()
    with open(vocabulary("piece_bpe_32k.model"), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # the library's own Viterbi search, on the same scores
    rank = 0
    for p in proto.pieces:
        if p.type == 1:
            p.score = pieces.score(rank)
            rank += 1
    library = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
    texts = [t for t in ODD if "▁" not in t and "\0" not in t] + [t for _, t in documents()[:80]]
    for text, ids in zip(texts, pieces.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text), text[:50]
    for text, ids in zip(ODD, pieces.encode(ODD), strict=True):
        assert pieces.decode(ids) == text
    got = {r["doc_id"]: r for r in piece_viterbi.round_trip(frame(spark, EDGES)).collect()}
    assert all(r["exact"] for r in got.values()) and got[2]["n_pieces"] == 0 and got[1]["n_pieces"] == 0
    back = piece_viterbi.decode(piece_viterbi.encode(frame(spark, EDGES)))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(((i, t or "") for i, t in EDGES), key=repr)
    assert piece_viterbi.round_trip(frame(spark, [])).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80))
def test_pieces_come_back_from_any_text(text):
    pieces = piece_viterbi.Pieces.of("piece_bpe_32k.model")
    assert pieces.decode(pieces.encode([text])[0]) == text
