"""Language identification and toxicity: held-out results and awkward rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

from inkstone.llm import language_id as L
from inkstone.llm import toxicity as X
from inkstone.llm.grams import hashed_grams, pieces

DATA = "/root/testdata/sf0.01"


def test_language_of_held_out_documents(spark):
    truth = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang")
    rows = L.op9_language_id(spark, DATA).join(truth, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 1000 and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_of_awkward_rows(awkward, nothing):
    model = L.train_language_model(awkward, held_out=None)
    got = L.predict_language(awkward, model)
    assert got.count() == awkward.count()
    for r in got.collect():
        assert (r["lang_pred"] == "und") == (r["text"] is None or not any(c.isalpha() for c in r["text"]))
    empty = L.train_language_model(nothing)
    assert empty.langs == [] and {r["lang_pred"] for r in L.predict_language(awkward, empty).collect()} == {"und"}
    assert L.predict_language(nothing, model).count() == 0


def test_long_texts_are_read_whole():
    text = "word " * 300_000 + "zzz"
    for overlap in (0, 50):
        rows, parts = zip(*[(r, p) for r, p in pieces(["a", text, None, ""], overlap=overlap)], strict=True)
        joined = [p for ps in parts for p in ps]
        assert len(joined) > 2 and joined[-1].endswith("zzz") and sum(map(len, joined)) >= len(text) + 1
    bucket, owner = hashed_grams(["ab", "abc"], 2, 3, 18)
    assert owner.tolist() == [0] * 5 + [1] * 7 and len(set(bucket[:5].tolist()) & set(bucket[5:].tolist())) == 3


def test_toxicity_of_held_out_documents(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = X.op6_toxicity(spark, DATA).join(labels, "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    clean = np.array([r["score"] for r in held if r["toxic"] == 0])
    toxic = np.array([r["score"] for r in held if r["toxic"] == 1])
    assert np.mean([np.mean(t > clean) for t in toxic]) > 0.8 and (clean >= 0.7).mean() < 0.05
    assert all(r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_misspellings_share_vectors_and_awkward_rows(spark, awkward, nothing):
    words = [f"{a}{b}" for a in ("lor", "mip", "san", "dol", "ret", "con") for b in ("em", "sum", "ect", "ius", "ant", "ora")]
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(words, 60).tolist() + (["dreadful"] * 4 if i % 4 == 0 else [])) for i in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("toxic"))
    model = X.train_toxicity_model(docs, labels.union(labels))
    seen, variant, clean = model.score([texts[1] + " dreadful" * 4, texts[1] + " dreadfull dredful dreadfuls dreaddful", texts[1]])
    assert seen > 0.7 and variant > clean + 0.2
    assert X.score_toxicity(awkward, model).where("toxicity between 0 and 1").count() == awkward.count()
    assert X.score_toxicity(nothing, model).count() == 0
    blank = X.train_toxicity_model(nothing, labels)
    assert X.score_toxicity(awkward, blank).where("toxicity < 0.01").count() == awkward.count()
