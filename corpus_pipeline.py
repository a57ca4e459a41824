"""A pipeline over documents: toxicity, quality rules, near-dedup, mixing, byte-level BPE.

Every stage's rows are written as Parquet to the folder that all executors
share and read again by the next one, so a lost executor costs a stage at most.
The folder of the last stage's rows stays, as the result reads it; the caller
may delete it (`run(...).inputFiles()` tells where it lies).
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

from stratalog.llm.common import give_back, shared_dir
from stratalog.llm.stages import STAGES

#: A trained network, a language model and a flow can't be told in SQL; the tests compare with plain versions.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def _tidy(spark: SparkSession) -> None:
    """Lets go what a stage left on the driver: models, plans, and shuffles that nothing reads any more."""
    gc.collect()
    give_back()
    spark._jvm.System.gc()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, last = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for number, (_, stage) in enumerate(STAGES):
        at = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if last:
            _delete(spark, last)
        last = at
        _tidy(spark)
    return docs
