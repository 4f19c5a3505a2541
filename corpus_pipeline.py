"""Corpus pipeline: toxic documents go, repeated line chunks go, one of each group of near-duplicates stays, sources are
mixed to target weights, and the mixture is packed into training sequences.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents, and any others that there are,
whatever they are called. A very long text is one row's work in every stage: toxicity and packing read it in slices, the
others within its row, in memory that grows with its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nubla.llm import line_dedup, minhash_dedup, mixing, packing, toxicity
from nubla.llm.common import table


#: Rows of a batch between the JVM and Python: with texts of some thousand characters, batches of the default size take tens of
#: megabytes on both sides of every task.
BATCH_ROWS = 1000


def _small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def _named(docs: DataFrame) -> list[str]:
    """The names of the columns, as ``select`` takes them whatever they hold."""
    return ["`" + c.replace("`", "``") + "`" for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the rows predicted toxic, by what the labels teach. Null and empty texts stay; repeated rows are judged alike;
    an empty table stays empty, and without labels the seed grammar judges."""
    _small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.keep_clean(docs, toxicity.fit(docs, labels))


def cut_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without pieces of text that occurred before; ``n_chars`` follows the text that stays. Every row stays, and a null or
    empty text as it is; rows equal in id and text are one document; an empty table stays empty."""
    out = line_dedup.remove_repeats(docs)
    size = F.when(F.col(out.columns[-1]).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))
    return out.withColumn("n_chars", size).select(_named(docs))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each near-duplicate group, once where rows repeat. Null texts are empty ones, which are
    copies of each other; rows without an id stay; an empty table stays empty."""
    _small_batches(spark)
    return minhash_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row once for each epoch of its source, once at least. A null source is one source; null texts and ids stay null;
    an empty table stays empty."""
    return mixing.mix(docs).select(_named(docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences. Each row is a document of one token at least, whether its text is null, its id is
    null or it repeats; an empty table gives none."""
    _small_batches(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", cut_repeated_lines),
    ("near_dedup", keep_one_of_each_group),
    ("mixing", mix_sources),
    ("packing", pack),
]
#: Learned scores, signatures and tokens are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
