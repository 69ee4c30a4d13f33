"""The subpackage's queries: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from . import bpe, host_quality, kneser_ney, mtree, packing, pii, simhash_dedup, substring_dedup, suffix_dedup, url_filter

QUERIES = {
    "op1_kneser_ney": kneser_ney.query,
    "op2_pii": pii.query,
    "op3_simhash": simhash_dedup.query,
    "op4_url_filter": url_filter.query,
    "op5_bpe": bpe.query,
    "op6_mtree": mtree.query,
    "op7_host_quality": host_quality.query,
    "op8_debruijn": substring_dedup.query,
    "op9_packing": packing.query,
    "op10_suffix_array": suffix_dedup.query,
}

#: The others cannot be said in SQL; tests hold them against brute force.
ORACLES = {"op6_mtree": mtree.ORACLE, "op7_host_quality": host_quality.ORACLE, "op8_debruijn": substring_dedup.ORACLE, "op10_suffix_array": suffix_dedup.ORACLE}
