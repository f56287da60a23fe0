"""The queries of this package and their SQL."""

from . import fingerprints, html_text, jaccard_join, licenses, mixing, packing, quality, sharding, suffix_dedup, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_mixing": mixing.op2_mixing,
    "op3_fingerprints": fingerprints.op3_fingerprints,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_sharding": sharding.op6_sharding,
    "op7_html_text": html_text.op7_html_text,
    "op8_packing": packing.op8_packing,
    "op9_quality_rules": quality.op9_quality_rules,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
}
ORACLE_SQL = {"op1_warc": warc.ORACLE, "op2_mixing": mixing.ORACLE}
