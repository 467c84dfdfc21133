"""Operators of training-data pipelines. Nothing else in the library imports this subpackage."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_extract, language_id, license_scan, packing, quality_classifier, quality_rules, secret_scan, simhash, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": license_scan.op1_license_scan,
        "op2_decontaminate": decontaminate.op2_decontaminate,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_quality_classifier": quality_classifier.op4_quality_classifier,
        "op5_secret_scan": secret_scan.op5_secret_scan,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_language_id": language_id.op7_language_id,
        "op8_simhash": simhash.op8_simhash,
        "op9_toxicity": toxicity.op9_toxicity,
        "op10_html_extract": html_extract.op10_html_extract,
        "quality_statistics": quality_rules.quality_statistics,
        "secret_counts": secret_scan.secret_counts,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.OP1_SQL, "quality_statistics": quality_rules.STATISTICS_SQL, "secret_counts": secret_scan.COUNTS_SQL}
