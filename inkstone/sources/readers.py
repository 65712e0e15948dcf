"""Readers: text files, delimited tables, labelled samples, uploads, history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

# --- Fixed values: what may be uploaded -------------------------------------------
UPLOAD_TYPES = ["txt", "md", "csv", "pdf", "docx", "pptx", "py", "js", "ts", "java", "cpp", "c", "cs",
                "php", "go", "rb", "kt", "swift", "sql"]
MAX_UPLOAD_BYTES = 15 * 1024 * 1024
MAX_IMAGE_BYTES = 10 * 1024 * 1024
SAMPLE_SCHEMA = "id string, text string, label string, `group` string, source string"


def read_table(spark: SparkSession, folder: str, name: str, parts: int | None = None) -> DataFrame:
    """A parquet table, split as Spark splits files, or dealt evenly to ``parts`` tasks.

    A file of one row group is one task however many cores wait; jobs that do much
    work within each row gain by ``parts``, for one shuffle of the table.
    """
    rows = spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
    return rows if parts is None else rows.repartition(parts)


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: path, name, text. Bytes that are not UTF-8 are dropped."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return raw.select(
        "path", F.element_at(F.split("path", "/"), -1).alias("file_name"),
        F.replace(F.make_valid_utf8(F.col("content").cast("string")), F.lit("�"), F.lit("")).alias("text"),
    )


def sniff_delimiter(header: str) -> str:
    return "\t" if header.count("\t") > header.count(",") else ","


def read_delimited(spark: SparkSession, path: str) -> DataFrame:
    """A table of strings; tab-separated if the header has more tabs than commas."""
    head = spark.read.text(path).filter(T.strip(F.col("value")) != "").first()
    sep = sniff_delimiter(head[0] if head else "")
    return spark.read.option("sep", sep).csv(path, header=True, inferSchema=False)


def read_samples(spark: SparkSession, path: str, groups: list[str] | None = None) -> DataFrame:
    df = spark.read.schema(SAMPLE_SCHEMA).json(path)
    return df if groups is None else df.filter(F.col("group").isin(*groups))


def union_labelled_sets(sets: list[tuple[DataFrame, str, str, str]], source: str) -> DataFrame:
    """Texts of several sets under one schema; ids are ``name#position``.

    Every set: (df with pos and document, name, label, group). Blank texts go.
    """
    out = None
    for df, name, label, group in sets:
        one = df.select(
            F.concat(F.lit(name + "#"), F.col("pos").cast("string")).alias("id"),
            T.strip(F.col("document")).alias("text"), F.lit(label).alias("label"),
            F.lit(group).alias("group"), F.lit(source).alias("source"),
        ).filter(F.col("text") != "")
        out = one if out is None else out.unionByName(one)
    return out


def explode_answers(questions: DataFrame, min_words: int = 60) -> DataFrame:
    """The first long enough answer per question and class.

    ``questions``: id, human_answers, machine_answers (arrays of strings).
    """

    def first(col: str) -> Column:
        return F.try_element_at(F.filter(col, lambda a: T.word_count(a) >= min_words), F.lit(1))

    both = F.array(
        F.struct(F.lit("human").alias("label"), first("human_answers").alias("text")),
        F.struct(F.lit("ai").alias("label"), first("machine_answers").alias("text")),
    )
    return questions.select("id", F.explode(both).alias("a")).select(
        F.concat("id", F.lit("/"), "a.label").alias("id"), T.strip(F.col("a.text")).alias("text"), "a.label",
    ).filter(F.col("text").isNotNull())


def admit_files(spark: SparkSession, path: str, max_bytes: int | None = MAX_UPLOAD_BYTES) -> DataFrame:
    """(path, size, extension, reason); the reason is empty for usable files.

    Only the listing is read, never the content. ``max_bytes`` is the limit of an
    upload; None admits files of any size.
    """
    meta = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    ext = F.lower(F.regexp_extract("path", r"\.([^./]*)$", 1))
    reason = (
        F.when(~ext.isin(*UPLOAD_TYPES), "unsupported type").when(F.col("length") == 0, "empty")
        .when(F.lit(False) if max_bytes is None else F.col("length") > max_bytes, "too large").otherwise("")
    )
    return meta.select("path", F.col("length").alias("size"), ext.alias("extension"), reason.alias("reason"))


def audit_images(files: DataFrame, content: str = "content", max_bytes: int | None = MAX_IMAGE_BYTES) -> DataFrame:
    """Adds mime and reason by size and leading bytes of the content."""
    head = F.hex(F.substring(content, 1, 12))
    mime = (
        F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp")
    )
    n = F.length(content)
    reason = (
        F.when(F.lit(False) if max_bytes is None else n > max_bytes, "too large").when(n == 0, "empty").when(mime.isNull(), "not a JPEG, PNG or WEBP")
        .otherwise("")
    )
    return files.withColumn("mime", F.when(reason == "", mime)).withColumn("reason", reason)


def read_corpus(chunks: DataFrame, history: DataFrame) -> DataFrame:
    """Stored passages with the name and date of the record they came from."""
    from ..operators.history import chunk_history_join

    return chunk_history_join(chunks, history).withColumn("kind", F.lit("submission"))

