"""The corpus pipeline: quality, near-duplicates, secrets, mixture and encoding, each over all that is left.

Every stage takes ``(spark, docs, sf_dir)`` and works on the whole of what its predecessor kept. All but
the last return the columns of ``docs``; the last returns ``doc_id, n_tokens, ids, decoded_sha256``.

All stages take columns of any name beside those of ``documents`` and pass them on; ids may be null or repeated, rows are
told apart by where they stand; very long texts are worked on whole, in blocks; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, crf, mixing, secrets, simhash
from tarn.llm.arrow import named
from tarn.llm.queries import TARGETS, domain_classifier
from tarn.plans.scratch import cut, sized

#: A text below this score is rejected.
LEAST_QUALITY = 0.3
RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose lines look bad. Learns from ``labels``, as far as those documents are here.

    A null or empty text is one empty line and stays or goes by that line's score; repeated rows stay or go together; without
    labelled rows every score is a half and all rows stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learned = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return crf.keep_good(docs, crf.train(docs, learned), LEAST_QUALITY)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of texts that share four fifths of their five-word shingles or more.

    It is the one of the smallest id, of the first row that bears it; rows without an id come last. Rows of one id are
    documents of their own, and go only if their texts are alike. Texts without words, null ones too, are one group.
    """
    key = "key"
    while key in docs.columns:
        key += " "
    # rows of one id are told apart by their texts; those that are alike in both are one document
    own = F.struct(F.isnull("doc_id"), "doc_id", F.xxhash64("text", "doc_id"), F.xxhash64(F.lit(7), "doc_id", "text"))
    rows = docs.withColumn(key, own)
    groups = cut(simhash.similar(rows, shingle=5, least=0.8, id_col=key).select(F.col("id").alias(key), "component_id"), "groups")
    first = F.col(key) == F.col("component_id")
    dropped = sized(cut(groups.where(~first).select(key).distinct(), "dropped"))
    repeated = sized(cut(groups.where(first).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "repeated"))
    kept = rows.join(dropped, key, "left_anti")
    if not repeated.isEmpty():
        kept = kept.join(repeated, key, "left_anti").unionByName(kept.join(repeated, key, "left_semi").dropDuplicates([key]))
    return kept.select(*map(named, docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every secret, plain or linked, by a mark; ``n_chars`` follows the text.

    Texts without secrets, null and empty ones among them, stay as they are; repeated rows are redacted each.
    """
    found = secrets.scan_kept(docs, keep=docs.columns)
    kept = {c: F.col("kept")[c] for c in docs.columns}
    clean = secrets.redact(kept["text"], F.array_sort(F.concat("base", "linked"), secrets.in_order))
    some = F.size("base") + F.size("linked") > 0
    found = found.withColumn("clean", clean)
    kept["text"] = F.col("clean")
    if "n_chars" in kept:
        kept["n_chars"] = F.when(some, F.length("clean")).otherwise(kept["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return found.select(*(value.alias(c) for c, value in kept.items()))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents so that the languages' token shares meet their targets; a document may be drawn repeatedly.

    A null or empty text has no tokens and is drawn by its posterior as any other; repeated rows of an id are drawn alike.
    """
    model = domain_classifier(spark, docs, sf_dir)
    rates = mixing.fit_rates(mixing.memberships(docs, model), list(TARGETS.values()))
    return mixing.draw(docs, model, rates)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and the digest of the bytes that they decode to; a null or empty text has no tokens."""
    ids = bpe.encode_texts(docs, RANKS, public_tokenizers.PATTERN)
    whole = bpe.decode_ids(ids, RANKS, public_tokenizers.PATTERN, ["doc_id", "ids"])
    n_tokens = (F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return whole.select("doc_id", n_tokens, "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mixture),
    ("encode", encode),
]

#: The classifiers and the shingle sets have no SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
