"""The registered queries of this package and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, collocations, decontaminate, jaccard, license_scan, packing, pii, quality, repeats, secret_scan, spelling, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": repeats.op1_suffix_dedup,
    "op2_decontamination": decontaminate.op2_decontamination,
    "op3_quality": quality.op3_quality,
    "op4_secrets": secret_scan.op4_secrets,
    "op5_warc": warc.op5_warc,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_ngram_jaccard": jaccard.op7_ngram_jaccard,
    "op7_ngram_jaccard_links": jaccard.op7_ngram_jaccard_links,
    "op8_pii": pii.op8_pii,
    "op9_packing": packing.op9_packing,
    "op10_ann": ann.op10_ann,
    "op11_license_scan": license_scan.op11_license_scan,
    "op12_spelling": spelling.op12_spelling,
    "op13_collocations": collocations.op13_collocations,
}
ORACLES: dict[str, str] = {
    "op1_suffix_dedup": repeats.OP1_SQL,
    "op5_warc": warc.OP5_SQL,
    "op7_ngram_jaccard": jaccard.OP7_SQL,
    "op7_ngram_jaccard_links": jaccard.OP7_LINKS_SQL,
    "op12_spelling": spelling.OP12_SQL,
    "op13_collocations": collocations.OP13_SQL,
}
