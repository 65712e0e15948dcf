"""Readers, writers, scratch folders and exact figures on awkward rows."""

import itertools

import pytest
from pyspark.sql import functions as F

from inkstone.operators import evaluate as E
from inkstone.operators import overlap as O
from inkstone.plans import overlap as P
from inkstone.session import scratch_base
from inkstone.sources import readers, writers
from inkstone.streaming import ingest


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def __init__(self, **kw):
            self.kw = kw

        def get(self, key, default=None):
            return self.kw.get(key, default)

    class Session:
        def __init__(self, **kw):
            self.conf = Conf(**kw)

    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]", "k8s://x"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_base(Session(**{"spark.master": master}))
    assert scratch_base(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs:///x/"})) == "hdfs:///x"


def test_bytes_that_are_not_utf8_are_dropped(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one \xff\xfetwo \xc3\xa9\xc3")
    got = {r["file_name"]: r["text"] for r in readers.read_text_files(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "one two é"}


def test_an_append_that_is_tried_again_writes_the_same_ids(spark, tmp_path):
    rows = spark.createDataFrame(
        [("a", "txt", "text", 1.0, 2.0, "low", "done", ("x",)), ("b", "txt", "text", 1.0, 2.0, "low", "done", ("y",))],
        "file_name string, file_type string, analysis_type string, ai_probability double, similarity_score double, confidence string, status string, result struct<n:string>",
    )
    for name, batch in (("one", "b1"), ("two", "b1"), ("three", "b2")):
        writers.append_history(rows, str(tmp_path / name), batch=batch)
    ids = [{r["id"] for r in spark.read.parquet(str(tmp_path / n)).collect()} for n in ("one", "two", "three")]
    assert ids[0] == ids[1] and len(ids[0]) == 2 and not ids[0] & ids[2]


def test_auroc_ranks_scores_with_all_their_digits(spark):
    scores = [(49.951, "human"), (49.952, "ai"), (50.04, "human"), (50.03, "ai"), (73.2, "ai"), (73.2, "human"), (12.0, "human"), (None, "ai")]
    got = E.auroc(spark.createDataFrame(scores, "score double, label string")).first()
    ai, human = ([s for s, x in scores if x == k and s is not None] for k in ("ai", "human"))
    want = sum((a > h) + 0.5 * (a == h) for a, h in itertools.product(ai, human)) / len(ai) / len(human)
    assert abs(got["auroc"] - want) < 1e-12


def test_term_counts_and_a_row_for_blank_documents(spark):
    p = spark.createDataFrame([("k", "b a b c a b"), ("l", "")], "key string, passage string")
    assert {(r["key"], r["term"], r["tf"]) for r in O.term_rows(p).collect()} == {("k", "a", 2), ("k", "b", 3), ("k", "c", 1)}
    docs = spark.createDataFrame([(1, "red green blue yellow"), (2, "   "), (3, None), (4, "one two three four"), (5, "five six seven")], "doc_id long, text string")
    rep = {r["doc_id"]: r for r in P.find_overlap(docs, docs.withColumn("tag", F.lit("s"))).collect()}
    assert rep[1]["top_match"] == 100.0 and [rep[i]["passages"] for i in (2, 3)] == [0, 0] and rep[2]["note"] == O.NOTE_EMPTY


def test_passage_numbers_of_far_ids_differ(spark):
    docs = spark.createDataFrame([(5, "one two three"), (5 + 2**40, "four five six")], "doc_id long, text string")
    assert len({r["chunk_id"] for r in P.corpus_passages(docs).collect()}) == 2


def test_only_a_missing_corpus_is_an_empty_one(spark, tmp_path):
    assert ingest.read_stored(spark, str(tmp_path / "none"), 1).count() == 0
    with pytest.raises(Exception):  # noqa: B017  a path that can't be read at all
        ingest.read_stored(spark, "nosuchstore://x/y", 1).count()
