"""The thin queries of this subpackage: name -> query over a folder of tables, and name -> DuckDB SQL.

The pipeline over them is registered beside them, in ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat_format, filter_audit, mixing, packing, partenum, pseudonyms, quality_model, quality_rules, secret_scan, token_alignment, toxicity, warc, weighted_sampling
from .common import table


def _over(name: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_model": _over("documents", quality_model.op1_quality_model),
    "op2_mixing": _over("documents", mixing.op2_mixing),
    "op3_packing": _over("documents", packing.op3_packing),
    "op4_pseudonyms": _over("documents", pseudonyms.op4_pseudonyms),
    "op5_weighted_sampling": _over("documents", weighted_sampling.op5_weighted_sampling),
    "op6_secret_scan": _over("documents", secret_scan.op6_secret_scan),
    "op7_partenum": _over("documents", partenum.op7_partenum),
    "op8_warc": lambda spark, sf_dir: warc.op8_warc(spark, table(spark, sf_dir, "pages")),
    "op9_quality_rules": _over("documents", quality_rules.op9_quality_rules),
    "op10_chat_format": _over("conversations", chat_format.op10_chat_format),
    "op11_toxicity": lambda spark, sf_dir: toxicity.op11_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op12_filter_audit": lambda spark, sf_dir: filter_audit.op12_filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op13_token_alignment": _over("documents", token_alignment.op13_token_alignment),
}
ORACLE_SQL: dict[str, str] = {
    "op9_quality_rules": quality_rules.ORACLE_SQL,
    "op10_chat_format": chat_format.ORACLE_SQL,
    "op12_filter_audit": filter_audit.ORACLE_SQL,
}
