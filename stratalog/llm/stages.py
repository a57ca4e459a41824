"""The stages of the pipeline over documents, each a function (spark, docs, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalog.llm import byte_bpe, kn_quality, mixing, simhash, toxicity
from stratalog.llm.common import bound_batches

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; null and empty texts, repeats and null ids included, each by its own score.

    Learns from the labelled rows of docs. A very long text is scored whole; extra columns go; an empty table stays empty.
    """
    bound_batches(spark)
    docs = docs.select(*COLUMNS)
    network = toxicity.train(*toxicity.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.score(docs, network, keep=tuple(COLUMNS)).where(F.col("score") < toxicity.THRESHOLD).select(*COLUMNS)


def _keyed(docs: DataFrame) -> DataFrame:
    """With a hash of the whole row: equal rows have equal verdicts."""
    return docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("__h"))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within their language's perplexity bands; empty and null texts fail them.

    Verdicts are made on keys and joined back, so texts are shuffled once. Repeated rows have one verdict and all stay
    or all go; a null id or language is a value like any other; extra columns go; an empty table stays empty.
    """
    bound_batches(spark)
    docs = _keyed(docs)
    kept = kn_quality.judge(docs, keep=("doc_id", "__h")).where("kept").select(F.col("doc_id").alias("__id"), F.col("__h").alias("__k")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__k")), "left_semi").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: of its rows the one with the smallest id (null last), at equal ids with the smallest hash.

    Rows are told apart by all their columns, so different texts under one id are different documents; of equal rows one
    stays. Texts without words form one group. Extra columns go; an empty table stays empty.
    """
    bound_batches(spark)
    docs = _keyed(docs)
    found = simhash.near_duplicates(docs, key="__h").select(F.col("__h").alias("__k"), F.col("component_id").alias("__c")).distinct()
    named = docs.select("doc_id", "__h").distinct().join(found, F.col("__h") == F.col("__k")).groupBy("__c").agg(F.min_by("__h", F.struct(F.col("doc_id").isNull(), "doc_id", "__h")).alias("__k"))
    first = docs.join(named.select("__k"), F.col("__h") == F.col("__k"), "left_semi").dropDuplicates(["__h"])
    return first.select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a document stands as often as it is used, up to three times; one used by less than half goes.

    A null or empty text has no size and goes; a null source is a source of its own; each of several equal rows is used
    for itself; extra columns go; an empty table stays empty.
    """
    docs = docs.select(*COLUMNS)
    mixed = mixing.mix(docs, mixing.word_count(F.col("text")), F.array("source"))
    uses = F.when(F.col("__size") > 0, F.floor(F.col("__taken") / F.col("__size") + 0.5)).otherwise(0).cast("int")
    return mixed.withColumn("__use", F.explode(F.when(uses > 0, F.sequence(F.lit(1), uses)).otherwise(F.array().cast("array<int>")))).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's token ids, their digest and that of the decoded bytes; null and empty texts have no ids.

    Repeated rows give repeated results; a very long text is encoded whole; an empty table stays empty.
    """
    bound_batches(spark)
    return byte_bpe.encode(docs, keep=("doc_id", "lang", "source"), digests=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality_rules", drop_low_quality),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]
