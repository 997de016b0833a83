"""Queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, html_wrapper, license_scan, packing, quality, secret_scan, simhash, token_files, url_rules, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_curve_packing": packing.op1_curve_packing,
    "op2_wrapper_induction": html_wrapper.op2_wrapper_induction,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_compression_bands": quality.op4_compression_bands,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_secret_scan": secret_scan.op6_secret_scan,
    "op7_url_rules": url_rules.op7_url_rules,
    "op8_token_files": token_files.op8_token_files,
    "op9_warc_revisits": warc.op9_warc_revisits,
    "op10_simhash_near_dup": simhash.op10_simhash_near_dup,
}

ORACLES: dict[str, str] = {
    "op3_license_scan": license_scan.SQL,
    "op7_url_rules": url_rules.SQL,
    "op9_warc_revisits": warc.SQL,
}
