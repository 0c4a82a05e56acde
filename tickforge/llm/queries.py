"""The queries of this subpackage and their SQL, where SQL expresses them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, langid, mixing, pii, quality_model, quality_rules, sharding, simhash, url_filter, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc_derivatives": warc.query,
    "op2_language_id": langid.query,
    "op3_pii_contextual": pii.query,
    "op4_quality_classifier": quality_model.query,
    "op5_simhash_bktree": simhash.query,
    "op6_sampled_splitters": sharding.query,
    "op7_hierarchical_mixing": mixing.query,
    "op8_line_first_rules": quality_rules.query,
    "op9_temporal_url_filter": url_filter.query,
    "op10_winnowing_decontamination": decontam.query,
}

ORACLES: dict[str, str] = {
    "op7_hierarchical_mixing": mixing.ORACLE,
    "op8_line_first_rules": quality_rules.ORACLE,
    "op9_temporal_url_filter": url_filter.ORACLE,
    "op10_winnowing_decontamination": decontam.ORACLE,
}
