"""The registry and a sample of queries against their SQL."""

import pytest

import __spark_entry__ as entry
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "quality_gate", "classify_block", "passage_windows", "pack_chunks", "find_overlap", "score_documents", "score_code",
    "combine_detectors", "evaluate_detector", "extractive_summary", "profile_table", "history_overview", "report_rows",
]


def test_sql_belongs_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 120


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    got = entry.queries()[name](spark, SF).toPandas()
    want = connect(SF).execute(entry.oracle_sql()[name]).df()
    assert compare(got, want).startswith("ok")


def test_headline_table(spark):
    """One local accusation is capped; agreement speaks; a split does not."""
    from inkstone.operators.opinions import detector_consensus, detector_headline

    rows = [
        (1, "heuristic", 80.0, "likely_ai", None), (2, "groq", 80.0, "likely_ai", None),
        (3, "heuristic", 80.0, "likely_ai", None), (3, "groq", 90.0, "likely_ai", None),
        (4, "heuristic", 20.0, "likely_human", None), (4, "groq", 90.0, "likely_ai", None),
        (5, "groq", None, "unavailable", "down"), (6, "heuristic", 20.0, "likely_human", None),
    ]
    df = spark.createDataFrame(rows, "doc_id long, provider string, ai_probability double, verdict string, error string")
    got = {r.doc_id: (r.verdict, r.basis) for r in detector_headline(df).collect()}
    assert got == {
        1: ("Uncertain", "single_capped"), 2: ("Likely AI", "single"), 3: ("Likely AI", "agreement"),
        4: ("Uncertain", "disagreement"), 5: ("Uncertain", "none"), 6: ("Likely Human", "single"),
    }
    kinds = {r.doc_id: r.agreement for r in detector_consensus(df).collect()}
    assert kinds == {1: "single", 2: "single", 3: "unanimous", 4: "conflicted", 5: "none", 6: "single"}


def test_failing_plugin_gives_error_rows(spark):
    from inkstone.operators.opinions import detector_plugin

    def broken():
        def score(texts):
            raise ValueError("no model")

        return score

    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    rows = detector_plugin("m", broken, docs).collect()
    assert len(rows) == 2 and all(r.error and r.verdict == "unavailable" and r.ai_probability is None for r in rows)
