"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stratalog.llm import byte_bpe, click_windows, collocations, html_crf, itq, kn_quality, license_scan, mixing, simhash, token_count, top_k, toxicity, url_filter
from stratalog.llm.common import bound_batches, read


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode(read(spark, sf_dir, "documents"), ids=False, digests=True)


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": kn_quality.query,
        "op2_url_filter": url_filter.query,
        "op3_license_scan": license_scan.query,
        "op4_html_extract": html_crf.query,
        "op5_byte_bpe": _bounded(op5),
        "op6_toxicity": toxicity.query,
        "op7_mixing": mixing.query,
        "op8_token_count": _bounded(token_count.query),
        "op9_itq": itq.query,
        "op10_simhash": simhash.query,
        "op11_collocations": _bounded(collocations.query),
        "op12_top_k": _bounded(top_k.query),
        "op13_click_windows": _bounded(click_windows.query),
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filter": url_filter.ORACLE, "op3_license_scan": license_scan.ORACLE, "op9_itq": itq.ORACLE, "op11_collocations": collocations.ORACLE, "op12_top_k": top_k.ORACLE, "op13_click_windows": click_windows.ORACLE}
