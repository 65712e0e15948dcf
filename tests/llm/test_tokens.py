"""Packing, token files and the piece codec: exact against the libraries, and exact round trips."""

import zlib

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkstone.llm import packing as P
from inkstone.llm import piece_codec as C
from inkstone.llm import token_files as T
from inkstone.llm.token_cache import WordCache

WORD, BYTE, PIECE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n\t ab'.1▁ \x85\x1cé"), st.characters(codec="utf-8")), max_size=60)


def whole(path, texts):
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    return [np.array(e.ids, dtype="<u4").tobytes() for e in t.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=40, deadline=None)
@given(st.lists(TEXT, max_size=12))
def test_cached_units_give_the_ids_of_whole_texts(texts):
    for path, kind in ((WORD, "word"), (BYTE, "byte")):
        assert list(WordCache(path, kind).encode(texts)) == whole(path, texts)


def test_a_full_cache_starts_again_and_long_texts_come_in_pieces(monkeypatch):
    texts = [" ".join(f"w{i * j % 701}x" for i in range(400)) for j in range(1, 9)]
    monkeypatch.setattr("inkstone.llm.token_cache.PIECE_CHARS", 500)
    for path, kind in ((WORD, "word"), (BYTE, "byte")):
        cache = WordCache(path, kind, limit=900)
        assert list(cache.encode(texts)) == whole(path, texts) and cache.n <= 900


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 20))
def test_packing_is_gapless_and_bounded(lengths, limit):
    lengths = np.array(lengths, dtype=np.int64)
    bins, offsets = P.pack_lengths(lengths, capacity=64, open_bins=limit)
    for b in set(bins.tolist()):
        own = sorted((o, n) for o, n, x in zip(offsets.tolist(), lengths.tolist(), bins.tolist(), strict=True) if x == b)
        at = 0
        for o, n in own:
            assert o == at
            at += n
        assert at <= 64


def test_best_fit_takes_the_tightest_bin_and_closes_the_fullest():
    state = P.OpenBins(10, 2)
    assert [state.put(x) for x in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    state = P.OpenBins(10, 2)
    assert [state.put(x) for x in (5, 7, 8, 5)] == [(0, 0), (1, 0), (2, 0), (0, 5)] and state.made == 3


def test_packed_documents(spark, awkward, nothing):
    rows = P.pack_documents(awkward, WORD, capacity=512).collect()
    texts = {}
    for r in awkward.collect():
        texts.setdefault(r["doc_id"], []).append(r["text"] or "")
    end = np.array([1], dtype="<u4").tobytes()
    want = sorted(
        (d if d is not None else -1, k, k * 512, len(c) // 4, zlib.crc32(c))
        for d, own in texts.items() for ids in whole(WORD, own) for k in range((len(ids + end) + 2047) // 2048) for c in [(ids + end)[2048 * k : 2048 * k + 2048]]
    )
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0] + [n for _, n in own])[:-1].tolist() and sum(n for _, n in own) <= 512
    assert len(by) <= np.ceil(sum(r["length"] for r in rows) / 512) + 1
    assert P.pack_documents(nothing, WORD).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 70_000), st.integers(0, 2**59)), max_size=400), st.integers(1, 90))
def test_simple8b_round_trip(ids, block):
    words, offsets = T.encode_ids(np.array(ids, dtype=np.uint64), block)
    assert T.decode_ids(words).tolist() == ids
    assert len(offsets) == -(-len(ids) // block) + 1
    for k in range(len(offsets) - 1):  # any block by itself
        assert T.decode_ids(words[offsets[k] : offsets[k + 1]]).tolist() == ids[k * block : (k + 1) * block]


def test_token_files_round_trip(spark, awkward, nothing, tmp_path):
    docs = awkward.where("doc_id is not null")
    T.write_token_files(docs, str(tmp_path / "a"), BYTE, segment_ids=200)
    got = T.read_token_files(spark, str(tmp_path / "a"), with_ids=True).orderBy("start").collect()
    own = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
    end, at = np.array([2], dtype="<u4").tobytes(), 0
    for r, (doc_id, _), ids in zip(got, own, whole(BYTE, [t for _, t in own]), strict=True):
        data = ids + end
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (doc_id, at, len(data) // 4, zlib.crc32(data))
        assert np.array(r["ids"], dtype="<u4").tobytes() == data
        at += len(data) // 4
    T.write_token_files(nothing, str(tmp_path / "b"), BYTE)
    assert T.read_token_files(spark, str(tmp_path / "b")).count() == 0


def test_token_files_keep_rows_without_an_id(spark, awkward, tmp_path):
    more = awkward.limit(1).select(*[F.lit(None).cast("long").alias(c) if c == "doc_id" else F.lit("another").alias(c) if c == "text" else F.col(c) for c in awkward.columns])
    docs = awkward.unionByName(more)
    T.write_token_files(docs, str(tmp_path / "a"), BYTE, segment_ids=200)
    got = T.read_token_files(spark, str(tmp_path / "a"), with_ids=True).orderBy("start").collect()
    own = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
    assert [r["doc_id"] for r in got] == [d for d, _ in own] and [d for d, _ in own].count(None) == 2
    end = np.array([2], dtype="<u4").tobytes()
    assert [np.array(r["ids"], dtype="<u4").tobytes() for r in got] == [x + end for x in whole(BYTE, [t for _, t in own])]
    data = [np.arange(n, dtype="<u4").tobytes() for n in range(11)]
    doc_ids, sizes, ids = T.read_segment(T.write_segment([None, 0, -1, *[None] * 7, 5], data))
    assert doc_ids.tolist() == [None, 0, -1, *[None] * 7, 5] and sizes.tolist() == list(range(11)) and len(ids) == 55


def test_a_damaged_segment_is_refused():
    data = T.write_segment([5], [np.arange(10, dtype="<u4").tobytes()])
    doc_ids, sizes, ids = T.read_segment(data)
    assert (doc_ids.tolist(), sizes.tolist(), ids.tolist()) == ([5], [10], list(range(10)))
    for bad in (b"X" + data[1:], data[:16] + b"\x09" + data[17:]):
        try:
            T.read_segment(bad)
        except ValueError:
            continue
        raise AssertionError


PLAIN, VARIED = C.PieceCodec(PIECE, 0.0, 1), C.PieceCodec(PIECE, 0.3, 1)


@settings(max_examples=60, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_pieces_round_trip(texts):
    for codec in (PLAIN, VARIED):
        assert [codec.decode(x) for x in codec.encode(texts, range(len(texts)))] == texts


@settings(max_examples=40, deadline=None)
@given(st.lists(TEXT.filter(lambda t: "▁" not in t and "\x00" not in t), max_size=8))
def test_without_dropout_ids_are_those_of_the_library(texts):
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in PLAIN.encode(texts, range(len(texts)))] == model.encode(texts)


def test_dropout_varies_by_document_and_seed_and_repeats(monkeypatch):
    text = "international organisations everywhere " * 20
    a, b = VARIED.encode([text, text], [1, 2])
    assert a != b and next(VARIED.encode([text], [1])) == a == next(C.PieceCodec(PIECE, 0.3, 1).encode([text], [1]))
    assert next(C.PieceCodec(PIECE, 0.3, 2).encode([text], [1])) != a and len(a) > len(next(PLAIN.encode([text], [1])))
    monkeypatch.setattr(C, "LONG_UNIT", 0)  # the heap gives what the batches give
    assert next(C.PieceCodec(PIECE, 0.3, 1).encode([text], [1])) == a
    monkeypatch.setattr(C, "BATCH_CHARS", 50)
    assert next(C.PieceCodec(PIECE, 0.3, 1, limit=30).encode([text], [1])) == a


def test_each_occurrence_is_drawn_by_itself(monkeypatch):
    codec, unit = C.PieceCodec(PIECE, 0.1, 1), "▁international"
    texts = [" ".join(["international"] * 500)] * 4
    out = list(codec.encode(texts, range(4)))
    ways = {ids for (u, _), ids in codec.varied.items() if u == unit} | {codec.plain[unit]}
    assert len(ways) > 20 and [codec.decode(x) for x in out] == texts
    # each is what the heap gives for the occurrence's own key
    for number, ids in enumerate(out):
        (units, keys, _), = codec._cut(texts[number], number)
        assert ids == b"".join(codec._spelled(u, codec.merge_one([codec.id_of.get(c, -1) for c in u], int(k))) for u, k in zip(units, keys, strict=True))
    monkeypatch.setattr(C, "MOST_SPANS", 3)  # by key where there are too many spans
    assert list(C.PieceCodec(PIECE, 0.1, 1).encode(texts, range(4))) == out


def test_encoded_and_decoded_rows(awkward, nothing):
    out = C.encode_documents(awkward, PIECE, check=True).collect()
    assert len(out) == awkward.count() and all(r["lossless"] for r in out)
    back = C.decode_documents(C.encode_documents(awkward, PIECE), PIECE).collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in back) == sorted((r["doc_id"] or 0, r["text"] or "") for r in awkward.collect())
    assert C.encode_documents(nothing, PIECE, check=True).count() == 0
