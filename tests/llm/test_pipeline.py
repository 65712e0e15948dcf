"""The pipeline against a plain version, and its stages on awkward rows."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.conftest import prose
from tests.llm.test_native import plain_spans
from tests.llm.test_repeats_and_links import plain_links, plain_removal, variants
from tests.llm.test_tokens import WORD, whole


def redacted(text):
    spans, out, stop = plain_spans(text), [], 0
    if not spans:
        return text
    for start, _, end in spans:
        if start > stop or not out:
            out.append(text[stop:start] + "[SECRET]")
        stop = max(stop, end)
    return "".join(out) + text[stop:]


def plain_pipeline(rows):
    rows = [(d, t) for d, t in rows if t and any(c.isalpha() for c in t)]
    classes = plain_links(sorted(rows))
    rows = [(d, t) for (d, t), (_, c, _) in zip(sorted(rows), classes, strict=True) if d == c]
    kept = plain_removal(rows, 50)
    rows = [(d, t if not gone else left) for (d, t), (_, _, left, gone) in zip(rows, kept, strict=True)]
    rows = [(d, redacted(t)) for d, t in rows]
    out, end = set(), np.array([1], dtype="<u4").tobytes()
    for (d, _), ids in zip(rows, whole(WORD, [t for _, t in rows]), strict=True):
        data = ids + end
        out |= {(d, k, 4096 * k, len(data[16384 * k : 16384 * k + 16384]) // 4, zlib.crc32(data[16384 * k : 16384 * k + 16384])) for k in range(-(-len(data) // 16384))}
    return out


def test_run_equals_the_plain_version(spark, tmp_path):
    shared = prose(900, 75)
    texts = [prose(i, 80 + i) for i in range(25)] + variants(3, 200, 15) + [prose(40, 30) + " " + shared + " " + prose(41 + i, 30 + i) for i in range(6)]
    texts += [prose(4, 84), "", None, "12 34", prose(60, 60) + " token = abcdef123456 " + prose(61, 20), "AKIA" + "QWERTYUIOPASDFGH" + " key " + prose(62, 55), prose(63, 4000)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == plain_pipeline(rows)
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in own) <= 4096 and min(own)[0] == 0 for own in by.values())
    assert len(by) <= -(-sum(r["length"] for r in got) // 4096) + 1


def test_stages_on_awkward_and_on_no_rows(spark, awkward, nothing, tmp_path):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "substring dedup", "secret scans", "best-fit packing"]
    for start, docs in (("a", awkward), ("b", nothing)):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, "")
            if k < 4:
                assert out.columns == docs.columns
            out.write.parquet(str(tmp_path / f"{start}{k}"))
            docs = spark.read.parquet(str(tmp_path / f"{start}{k}"))
            if k < 4 and start == "a":
                rows = docs.collect()
                assert all(r["kept"] == "own" and r["secrets"] == "own" and r["node"] == "own" for r in rows)
                assert all(r["n_chars"] == len(r["text"]) for r in rows)
        assert (docs.count() > 0) == (start == "a")
    left = {r["doc_id"] for r in spark.read.parquet(str(tmp_path / "a1")).collect()}
    assert 1 in left and not left & {2, 3, 4, 5, 8, 9} and None in left and spark.read.parquet(str(tmp_path / "a1")).where(F.col("doc_id") == 1).count() == 1


def test_rows_go_only_for_a_similar_or_equal_text(spark):
    """Different texts under one doc_id stay, and so do near copies of a text whose id has another text."""
    rows = [(1, prose(i, 80)) for i in range(3)] + [(1, None), (1, None), (2, prose(1, 79) + " other"), (0, prose(2, 80) + " more"), (3, None), (3, ""), (4, prose(9, 70)), (4, prose(9, 70))]
    docs = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_duplicates(docs).collect()), key=str)
    assert got == sorted([(1, rows[0][1]), (1, rows[1][1]), (0, rows[6][1]), (1, None), (3, None), (3, ""), (4, rows[9][1])], key=str)


def test_language_stage_with_all_some_and_no_labels(spark):
    texts = [("en" if i % 2 else "fr", " ".join(("the house of my brother" if i % 2 else "la maison de mon frère").split() * (3 + i % 4))) for i in range(60)]
    rows = [(i, t, lang) for i, (lang, t) in enumerate(texts)] + [(90, "12 34", "en"), (91, None, "en"), (92, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    stage = corpus_pipeline.identify_language
    nulls = docs.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(map(tuple, stage(nulls).collect())) == sorted(map(tuple, nulls.where("doc_id < 90").collect()))
    partly = docs.withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.col("lang")))
    assert {r["doc_id"]: r["lang"] for r in stage(partly).collect()} == {i: lang for i, (lang, _) in enumerate(texts)}
    one = docs.withColumn("lang", F.lit("en"))
    assert stage(one).count() == 60
