"""Token counts kept by digest of content and of tokenizer, so that only new texts are encoded.

A text is brought to a normal form that has the same count under its tokenizer, and
named by the SHA-256 of that form; the tokenizer is named by a digest of its file,
its library and the rule for the normal form. The cache is a folder of Parquet files
(version, digest, n_tokens), parted by version. A run joins its distinct digests
with the stored ones, encodes one text for each digest that is missing, appends
the new counts, and joins all counts back to the rows.
"""

from __future__ import annotations

import hashlib
import importlib.metadata
import json
from collections.abc import Callable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkstone.llm.shared import kept_in_process, release_memory, table, text_of
from inkstone.llm.token_cache import word_cache
from inkstone.session import materialize, scratch_dir

#: Part of the version digest: raise it when the normal form changes.
NORMAL_FORM = "2"
#: Up to so many missing digests (32 bytes each) are sent to the texts, instead of the texts to them.
FEW_MISSING = 100_000
#: A digest with at least this part of all rows is joined by broadcast; there can be no more such digests than this number.
HOT_PART = 1000
ENCODED_CHARS = 1_000_000
#: Plain white space other than a single space.
ODD_GAP = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def _described(path: str) -> tuple[str, list[str]]:
    """How the file's tokenizer cuts texts (word, byte, other, pieces), and its special strings."""
    if not path.endswith(".json"):
        return "pieces", []
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    special = [x["content"] for x in told.get("added_tokens") or []]
    steps = [x["type"] for x in (told.get("normalizer") or {}).get("normalizers", [])]
    before = told.get("pre_tokenizer") or {}
    if steps == ["NFC", "Replace", "Lowercase"] and told["model"].get("end_of_word_suffix") == "</w>" and not any(set(s) & set(" \t\n\v\f\r") for s in special):
        return "word", special
    if told.get("normalizer") is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space"):
        return "byte", special
    return "other", special


def tokenizer_version(path: str) -> str:
    """Digest of all that a count depends on besides the text."""
    library = "tokenizers" if path.endswith(".json") else "sentencepiece"
    seen = hashlib.sha256(f"{library} {importlib.metadata.version(library)} {NORMAL_FORM}\n".encode())
    with open(path, "rb") as f:
        for block in iter(lambda: f.read(1 << 20), b""):
            seen.update(block)
    return seen.hexdigest()


def normal_form(text: Column, path: str) -> Column:
    """A form of the text with the same number of tokens, equal for more texts.

    Vocabularies that drop white space and case: runs of plain white space become
    one space, and plain ASCII without the letters of a special string loses its
    case (beyond ASCII, case decides which marks can be composed). Others: the text.
    """
    kind, special = _described(path)
    if kind != "word":
        return text
    joined = F.trim(F.regexp_replace(text, ODD_GAP, " "))
    plain = F.octet_length(joined) == F.char_length(joined)
    for s in special:
        plain &= ~F.lower(joined).contains(s.lower())
    return F.when(plain, F.lower(joined)).otherwise(joined)


def token_counter(path: str) -> Callable[[list[str]], list[int]]:
    """Counts of whole texts as the library gives them; words seen before are not encoded again."""
    kind, special = _described(path)
    if kind == "pieces":
        pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in pieces.encode(texts, num_threads=1)]
    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()

    def library(texts: list[str]) -> list[int]:
        return [len(e.ids) for e in whole.encode_batch_fast(texts, add_special_tokens=False)]

    if kind == "other":
        return library
    cache = word_cache(path, kind)

    def counts(texts: list[str]) -> list[int]:
        # special strings become single ids in the library, the word cache takes them as text
        odd = {i for i, t in enumerate(texts) if any(s in t for s in special)}
        rest = iter(library([texts[i] for i in sorted(odd)]) if odd else ())
        own = iter(cache.encode([t for i, t in enumerate(texts) if i not in odd]))
        return [next(rest) if i in odd else len(next(own)) // 4 for i in range(len(texts))]

    return counts


def _slices(texts: pa.Array) -> Iterator[list[str]]:
    """The texts, about ENCODED_CHARS bytes of them at a time."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + ENCODED_CHARS)))
        yield texts.slice(at, stop - at).to_pylist()
        at = stop


def _encoded(texts: DataFrame, path: str) -> DataFrame:
    """digest, n_tokens of rows (digest, normal)."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = kept_in_process(("counts", path), lambda: token_counter(path))
        for batch in batches:
            found = [n for some in _slices(batch.column(1)) for n in counts(some)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, type=pa.int64())], names=["digest", "n_tokens"])
            release_memory()

    return texts.select("digest", "normal").mapInArrow(counted, "digest binary, n_tokens long")


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """digest, n_tokens of one tokenizer version; a folder that does not exist yet is made."""
    schema = "version string, digest binary, n_tokens long"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(cache)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        spark.createDataFrame([], schema).write.partitionBy("version").parquet(cache)
    return spark.read.schema("digest binary, n_tokens long, version string").parquet(cache).where(F.col("version") == version).select("digest", "n_tokens")


def count_tokens(docs: DataFrame, path: str, cache: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_bytes, n_tokens: one row for each row of ``docs``, with the counts in the folder ``cache`` and new ones added to it.

    Null texts count as empty; null and repeated keys keep their rows; other columns
    are not read, whatever their names. Equal texts, however many, are encoded once.
    Tables without rows give none and add nothing. Several runs may read a cache at
    once; runs that append to one must follow each other. Counts stored twice do no
    harm, and a run that fails adds nothing.
    """
    spark, version = docs.sparkSession, tokenizer_version(path)
    source = docs.select(F.col(key).alias("key"), text_of(text).alias("text"))
    source = source.select("key", F.octet_length("text").cast("long").alias("n_bytes"), normal_form(F.col("text"), path).alias("normal"))
    source = source.withColumn("digest", F.unhex(F.sha2("normal", 256)))
    rows = materialize(source.select("key", "n_bytes", "digest"), "digests")
    sizes = materialize(rows.groupBy("digest").agg(F.count("*").alias("n")), "distinct")
    missing = materialize(sizes.select("digest").join(stored_counts(spark, cache, version), "digest", "left_anti"), "missing")
    n_missing = missing.count()
    if n_missing:
        texts = source.select("digest", "normal")
        if n_missing <= FEW_MISSING:
            texts = texts.join(F.broadcast(missing), "digest", "left_semi").dropDuplicates(["digest"])
        else:
            texts = texts.dropDuplicates(["digest"]).join(missing, "digest", "left_semi")
        _encoded(texts, path).withColumn("version", F.lit(version)).write.mode("append").option("compression", "zstd").partitionBy("version").parquet(cache)
    counts = stored_counts(spark, cache, version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    total = rows.count()
    hot = sizes.where(F.col("n") * HOT_PART >= total).select("digest")
    crowded = rows.join(F.broadcast(counts.join(F.broadcast(hot), "digest", "left_semi")), "digest")
    others = rows.join(F.broadcast(hot), "digest", "left_anti").join(counts, "digest")
    return crowded.unionByName(others).select(F.col("key").alias(key), "n_bytes", "n_tokens")


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), scratch_dir(spark, "token-counts"))
    return found.withColumn("over_limit", F.col("n_tokens") > 2048)


QUERIES = {"op13_token_counts": op13_token_counts}
