"""Cleaning a corpus: from ``documents`` to packed training sequences.

Five stages, each over all that the one before kept: quality rules, line
deduplication, SimHash near-duplicates, mixing to target weights, best-fit
packing.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtab.llm.common import WORD, materialise
from logtab.llm.linededup import dedup_lines
from logtab.llm.mixing import sample_mixture
from logtab.llm.packing import pack, text_cluster, word_count
from logtab.llm.quality import keep_good
from logtab.llm.simhash import keep_one_per_group


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others stay as they are."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go.  ``n_chars`` follows a changed
    text; a document that loses all its words goes with them."""
    # names by place: those of ``docs`` may be any
    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    done = dedup_lines(docs.toDF(*place.values()), place["doc_id"], place["text"], counts=True)
    changed = F.col("n_repeats") + F.col("n_near") > 0
    left = done.where(~changed | F.col(place["text"]).rlike(WORD))
    if "n_chars" in place:
        n = place["n_chars"]
        length = F.when(changed, F.char_length(place["text"])).otherwise(F.col(n))
        left = left.withColumn(n, length.cast(docs.schema["n_chars"].dataType))
    return left.select(*place.values()).toDF(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays, the one of smallest id."""
    return keep_one_per_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn so that sources, languages and topics come near their
    target weights."""
    return sample_mixture(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where every piece of every document lies in the training sequences."""
    return pack(docs, "doc_id", word_count(F.col("text")), F.col("source"), text_cluster(F.col("text")))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("mixing", mixing),
    ("best-fit packing", packing),
]

# No stage but the fixed quality rules can be put as SQL: the tests hold the
# stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
