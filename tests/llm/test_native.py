"""Secret scan and quality rules."""

import hashlib
import math
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkstone.llm import quality_rules as Q
from inkstone.llm import secret_scan as S
from tests.llm.conftest import prose

ASSIGN = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww](?:[Oo][Rr][Dd]|[Dd]))|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    for m in re.finditer(S.CANDIDATE, text):
        if any(re.search(p, m[0]) for p in S.ALLOWED):
            continue
        bits = next(b for _, p, b in S.CLASSES if re.search(p, m[0]))
        windows = [Counter(m[0][i : i + S.WINDOW]) for i in range(len(m[0]) - S.WINDOW + 1)]
        if min(sum(round(1e6 * n * math.log2(n)) for n in w.values()) for w in windows) <= S.ceiling(bits):
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_secret_spans_equal_brute_force(spark):
    key = "Zk3qPw8vXn2bRt7LmYc5"
    texts = [
        None, "", "token: token: abcdefgh", "API_KEY = 'abc'", f"é password=\"{key}\" tail", "AKIA" + "A" * 16 + " AKIAAKIA" + "B" * 12, "0123456789abcdef" * 3,
        "0123456789abcdef01234567g", f"{key} and {key.lower()}", "aaaaaaaaaaaaaaaaaaaaaaaa", "123e4567-e89b-12d3-a456-426614174000", "Secret=x==yyyyyy=",
        "\U0001f600 passwd : " + key, f"example{key}", "path/to/some/file/in/a/folder", " ".join(f"token={key}{i}" for i in range(700)), "einlichkeitverkeitach x",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: [tuple(x) for x in r["secrets"]] for r in S.scan_secrets(docs).collect()}
    assert got == {i: plain_spans(t) for i, t in enumerate(texts)}
    cleaned = {r["doc_id"]: r["text"] for r in S.redact_secrets(docs).collect()}
    assert cleaned[0] is None and cleaned[1] == "" and key not in cleaned[15] and cleaned[4] == "é [SECRET]\" tail" and cleaned[16] == texts[16]


def test_window_minimum_is_that_of_every_window(spark):
    @settings(max_examples=1, deadline=None)
    @given(st.lists(st.text(alphabet=S.ALPHABET, min_size=20, max_size=60), min_size=40, max_size=60))
    def check(texts):
        rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.window_minimum(F.col("t")).alias("m")).collect()
        for r in rows:
            windows = [Counter(r["t"][i : i + 20]) for i in range(len(r["t"]) - 19)]
            assert r["m"] == min(sum(round(1e6 * n * math.log2(n)) for n in w.values()) for w in windows)

    check()


def test_secret_scan_of_awkward_rows(awkward, nothing):
    got = S.scan_secrets(awkward)
    assert got.count() == awkward.count() and all(r["secrets"] == [] for r in got.where("text is null").collect())
    assert S.scan_secrets(nothing).count() == 0 and S.redact_secrets(nothing).count() == 0
    cut = S.redact_secrets(awkward)
    assert cut.columns == awkward.columns and {r["secrets"] for r in cut.collect()} == {"own"}


def plain_measures(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    at = {}
    for i in range(len(words) - 2):
        at.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {q for p in at.values() if len(p) > 1 for i in p for q in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_measures_equal_brute_force(spark, awkward):
    texts = ["a b c a b c", "a a a a a", "x\nx\n \n \nx y", "## $ <b>", prose(3, 300) + " " + prose(3, 100), "a b c d a b c e b c d", "é\x0bü\x85x"]
    docs = awkward.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    for r in Q.document_measures(docs).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_measures(r["text"])


def test_hosts_are_shrunk_and_joined_back(spark, awkward, nothing):
    good, bad = prose(2, 90), "too short"
    rows = [(i, bad if i % 10 else good, "poor") for i in range(200)] + [(1000 + i, good, "fine") for i in range(200)] + [(5000, bad, "tiny")]
    rows += [(6000 + 20 * h + i, good if i else bad, f"h{h}") for h in range(8) for i in range(20)] + [(9000, good, None)]
    out = {r["doc_id"]: r for r in Q.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(out) == len(rows)
    assert out[10]["host_rejected"] and not out[10]["base_failed"] and not out[10]["kept"]
    assert all(out[1000 + i]["kept"] for i in range(200)) and not out[5000]["kept"]
    assert out[5000]["host_rate"] < 1 and out[9000]["kept"]
    assert Q.quality_rules(awkward).count() == awkward.count() and Q.quality_rules(nothing).count() == 0


def test_no_python_in_native_plans(awkward):
    for plan in (S.scan_secrets(awkward), S.redact_secrets(awkward), Q.quality_rules(awkward)):
        text = plan._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Arrow|Pandas", text)


def test_digest_of_spans(spark):
    row = spark.createDataFrame([(1, "token=abcdef12 " + "0af" * 9)], "doc_id long, text string").select(S.spans_text(S.secret_spans(F.col("text"))).alias("s")).first()
    assert row["s"].startswith("assign:0:14,hex:15:42") and len(hashlib.sha256(row["s"].encode()).hexdigest()) == 64
