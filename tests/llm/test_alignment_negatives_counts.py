"""Token alignment, hard negatives and cached counts against plain versions of the same rules."""

import hashlib
import random
from collections import Counter, defaultdict
from math import floor, isfinite

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkstone.llm import digest_counts as D
from inkstone.llm import hard_negatives as H
from inkstone.llm import token_alignment as A
from inkstone.llm.token_cache import BYTE_LETTERS

WORD, BYTE, PIECE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
ODD = ["a b", "x\ty", "▁", "a▁b", "\x00", "q\x00 r", " lead", "trail  ", "  ", "\n\nx y\n z", "<|endoftext|> z", "<s> a </s>", "naïve café 🙂 ok", "it's we'll 12 345", "\xa0b c", "日本 語 text", "é e"]
TEXT = st.text(alphabet=st.one_of(st.sampled_from(" \n\t ab'.1▁\x85é"), st.characters(codec="utf-8")), max_size=40)


# -- alignment ------------------------------------------------------------------------------------


def plain_alignment(rows):
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, sha256) of each row, and the counts of pairs."""
    first, second = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    first.encode_special_tokens = True
    byte = {v: k for k, v in BYTE_LETTERS.items()}
    done, documents, links_in = [], Counter(), Counter()
    for key, text in rows:
        found = None
        if text:
            raw = (" " + text).encode()
            a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
            left = [bytes(byte[c] for c in first.id_to_token(i)) for i in a]
            right = [bytes([int(second.id_to_piece(i)[1:-1], 16)]) if second.is_byte(i) else second.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(left) == raw == b"".join(right):
                ends = [np.cumsum([len(x) for x in side]).tolist() for side in (left, right)]
                spans = [list(zip([0, *e[:-1]], e, strict=True)) for e in ends]
                links = [(a[i], b[j]) for i, (s, e) in enumerate(spans[0]) for j, (u, v) in enumerate(spans[1]) if s < v and u < e]
                both, groups, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
                for stop in both:
                    x, y = ends[0].index(stop) + 1, ends[1].index(stop) + 1
                    groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
                    i, j = x, y
                found = (len(a), len(b), len(groups), links, ";".join(groups))
                documents.update(set(links))
                links_in.update(links)
        done.append((key, found))
    highest = defaultdict(int)
    for (i, _), n in documents.items():
        highest[i] = max(highest[i], n)
    out = []
    for key, found in done:
        if found is None:
            out.append((key, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, text = found
        best = sum(documents[x] == highest[x[0]] for x in links)
        out.append((key, n_a, n_b, n_groups, len(links), best, sum(documents[x] for x in links), hashlib.sha256(text.encode()).hexdigest()))
    return out, documents, links_in


def order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is not None, r))


def test_aligned_documents(spark, awkward, nothing, monkeypatch):
    rng = random.Random(3)
    words = "The quick brown foxes, unbelievably jumped! over 42 lazy dogs' x=y; naïveté straße".split()
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100 + i, " ".join(rng.choices(words, k=rng.randint(1, 60)))) for i in range(60)] + [(5, ODD[5]), (None, "one more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("chunk", F.lit("own")).withColumn("pair", F.lit(1)).repartition(5)
    for given_ in (docs, awkward.where("length(text) < 50000 or text is null").where("doc_id <> 7 or doc_id is null"), nothing):
        want, _, _ = plain_alignment([(r["doc_id"], r["text"]) for r in given_.collect()])
        assert order(A.align_documents(given_, BYTE, PIECE).collect()) == order(want)
    texts = {r["doc_id"]: r["groups"] for r in A.align_documents(docs.where("doc_id >= 100"), BYTE, PIECE, written=True).collect()}
    want, pairs, links = plain_alignment(rows)
    assert all(hashlib.sha256(texts[r[0]].encode()).hexdigest() == r[7] for r in want if r[0] is not None and r[0] >= 100)
    got = {(r["a_id"], r["b_id"]): (r["n_docs"], r["n_links"]) for r in A.token_pairs(docs, BYTE, PIECE).collect()}
    assert got == {p: (n, links[p]) for p, n in pairs.items()}


def test_registered_alignment_of_long_texts(spark, awkward, tmp_path):
    from inkstone.llm import registry

    docs = awkward.where("doc_id in (7, 9, 11)").select("doc_id", "text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.load()[0]["op11_token_alignment"](spark, str(tmp_path)).collect()
    rows = [(r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["groups_sha256"]) for r in got]
    first, second = Tokenizer.from_file(BYTE), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert [(r[0], r[1], r[2]) for r in sorted(rows)] == [(d, len(first.encode(" " + t).ids), len(second.encode(t))) for d, t in sorted(texts.items())]
    # in small pieces, chunks and tables the figures stay the same
    table = A.UnitTable(BYTE, PIECE, limit=500)
    pieces, A.BATCH_CHARS = A.BATCH_CHARS, 700
    try:
        chunks = A._Chunks(table, 0, False)
        out = [b for b in chunks.add(list(texts), list(texts.values()))] + list(chunks.flush())
    finally:
        A.BATCH_CHARS = pieces
    facts = [tuple(b[n][i].as_py() for n in ("key", *A.FACTS, "groups")) for b in out for i in range(b.num_rows) if not b["pair"][i].is_valid]
    assert sorted(facts) == sorted(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 6), st.integers(0, 99), st.integers(1, 300)), max_size=250), st.integers(100, 4000))
def test_bitmaps_merge_and_open(entries, n_docs):
    parts = [(np.array([p << 16 | d for p, d, _ in some], dtype=np.int64), np.array([n for *_, n in some], dtype=np.int64)) for some in (entries[:90], entries[90:]) if some]
    want = Counter()
    for p, d, n in entries:
        want[p, d] += n
    if not parts:
        return
    pair, counts, docs, planes = A.containers(*A.merged(parts), n_docs)
    row, place, links = A.opened(counts, docs, planes)
    assert {(int(pair[r]), int(d)): int(n) for r, d, n in zip(row, place, links, strict=True)} == want
    assert all(len(d) <= (-(-n_docs // 8) | 1) for d in docs)


# -- hard negatives ---------------------------------------------------------------------------------


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 20), st.integers(0, 4), st.integers(1, 6), st.integers(1, 20), st.integers(0, 2**32))
def test_scores_by_tables_are_inner_products(d, n, m, bits, seed):
    rng = np.random.default_rng(seed)
    a, c = rng.integers(-(2 ** (bits - 1)), 2 ** (bits - 1), (m, d)), rng.integers(-(2 ** (bits - 1)), 2 ** (bits - 1), (n, d))
    assert (H.scores(H.subset_sums(a), H.bit_planes(c, bits)) == c @ a.T).all()


def plain_negatives(rows, is_anchor, label):
    fine = [(i, label(i, y), [floor(256 * float(x)) for x in v]) for i, v, y in rows if None not in (i, v, y) and len(v) == 5 and all(x is not None and isfinite(x) for x in v)]
    out = []
    for n, (i, y, v) in enumerate(fine):
        if not is_anchor(i):
            continue
        scored = sorted((-sum(p * q for p, q in zip(v, w, strict=True)), j, z) for m, (j, z, w) in enumerate(fine) if m != n)
        for s, j, _ in [x for x in scored if x[2] == y][:5]:
            negatives = [x for x in scored if x[2] != y and 80 * -s <= 100 * -x[0] <= 100 * -s][:5]
            out += [(i, j, k + 1, x[1], -s, -x[0]) for k, x in enumerate(negatives)]
    return sorted(out)


def test_hard_negatives(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, [round(rng.gauss(0.3, 0.4), 1) for _ in range(5)], rng.randint(0, 3)) for i in range(260)]
    rows += [(300, rows[0][1], 1)] * 40 + [(300, rows[3][1], 2), (None, rows[1][1], 1), (301, None, 1), (302, rows[1][1], None), (303, [1.0, None, 0.0, 0.0, 0.0], 1)]
    rows += [(304, [float("nan"), 0.0, 0.0, 0.0, 0.0], 1), (305, [float("inf"), 0.0, 0.0, 0.0, 0.0], 1), (306, [], 1), (307, [1.0, 2.0], 1), (308, [0.0] * 5, 1), (309, [-300.0] * 5, 2)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("anchor", F.lit("own")).withColumn("row", F.lit("own"))
    monkeypatch.setattr(H, "ANCHORS", 7)
    monkeypatch.setattr(H, "LEAST_CANDIDATES", 50)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    got = H.hard_negatives(table, F.col("vec_id") % 20 == 0, label)
    want = plain_negatives(rows, lambda i: i % 20 == 0, lambda i, y: (y + 1) % 10 if i % 7 == 0 else y)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100
    assert H.hard_negatives(table.limit(0), F.col("vec_id") % 20 == 0, label).count() == 0
    assert H.hard_negatives(table, F.lit(False), label).count() == 0


# -- counts -----------------------------------------------------------------------------------------


def library_counts(path, texts):
    if path.endswith(".model"):
        return [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)]
    return [len(e.ids) for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=40, deadline=None)
@given(st.lists(TEXT, max_size=8))
def test_counters_count_as_the_library(texts):
    texts += ["a<|endoftext|>b", "A<|ENDOFTEXT|> <|startoftext|>", "H̱ ẖ"]
    for path in (WORD, BYTE, PIECE):
        assert D.token_counter(path)(texts) == library_counts(path, texts)


def test_normal_forms_keep_counts(spark):
    rng = random.Random(9)
    bits = ["A", "b", "Z", " ", "  ", "\t", "\n \x0b", "̱", "́", "É", "İ", "<|endoftext|>", "<|EndOfText|>", "'S", "9", " ", "ſ", "K", "."]
    texts = sorted({"".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(1500)})
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("normal", D.normal_form(F.col("text"), WORD)).collect()
    assert library_counts(WORD, [r["text"] for r in rows]) == library_counts(WORD, [r["normal"] for r in rows])
    assert len({r["normal"] for r in rows}) < len(texts)


def test_counts_come_from_the_cache(spark, awkward, nothing, tmp_path, monkeypatch):
    cache = str(tmp_path / "cache")
    sizes = lambda: spark.read.parquet(cache).count()
    assert D.count_tokens(nothing, WORD, cache).count() == 0 and D.stored_counts(spark, cache, "x").count() == 0
    for path in (WORD, PIECE):
        got = D.count_tokens(awkward, path, cache).collect()
        rows = awkward.collect()
        want = [(r["doc_id"], len((r["text"] or "").encode()), n) for r, n in zip(rows, library_counts(path, [r["text"] or "" for r in rows]), strict=True)]
        assert order(got) == order(want)
    before = sizes()
    assert before == len({" ".join((r["text"] or "").split()) for r in awkward.collect()}) + len({r["text"] or "" for r in awkward.collect()})
    # a second run adds nothing and believes what is stored; another version starts anew
    version = D.tokenizer_version(WORD)
    spark.createDataFrame([(version, bytearray(hashlib.sha256(b"never seen").digest()), 77)], "version string, digest binary, n_tokens long").write.mode("append").partitionBy("version").parquet(cache)
    more = awkward.limit(3).select("doc_id", "text").unionByName(spark.createDataFrame([(50, "Never \n SEEN"), (51, "brand new")], "doc_id long, text string"))
    got = {r["doc_id"]: r["n_tokens"] for r in D.count_tokens(more, WORD, cache).collect()}
    assert got[50] == 77 and got[51] == 2 and sizes() == before + 2
    monkeypatch.setattr(D, "NORMAL_FORM", "other")
    assert {r["doc_id"]: r["n_tokens"] for r in D.count_tokens(more, WORD, cache).collect()}[50] == 2
    # texts go to the missing digests where these are many
    monkeypatch.setattr(D, "FEW_MISSING", 0)
    again = D.count_tokens(awkward, WORD, str(tmp_path / "other"))
    rows = awkward.collect()
    assert sorted(r["n_tokens"] for r in again.collect()) == sorted(library_counts(WORD, [r["text"] or "" for r in rows]))


def test_a_hot_text_is_encoded_once(spark, tmp_path):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "the same text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    got = D.count_tokens(docs, WORD, str(tmp_path / "c"))
    assert got.count() == 4000 and got.where("doc_id % 3 > 0").agg(F.min("n_tokens"), F.max("n_tokens")).first()[:] == (3, 3)
    assert spark.read.parquet(str(tmp_path / "c")).count() == 1334 + 1
