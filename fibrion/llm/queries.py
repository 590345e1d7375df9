"""The queries of this subpackage and their SQL."""

from . import ann_search, exact_dedup, html_extract, language_id, license_scan, mixing, sentencepiece_codec, simhash_dedup, token_output, toxicity

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_html_text": html_extract.op2_html_text,
    "op3_nearest": ann_search.op3_nearest,
    "op4_sentencepiece": sentencepiece_codec.op4_sentencepiece,
    "op5_token_output": token_output.op5_token_output,
    "op6_licenses": license_scan.op6_licenses,
    "op7_simhash": simhash_dedup.op7_simhash,
    "op8_mixing": mixing.op8_mixing,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
}
ORACLE_SQL = {"op3_nearest": ann_search.OP3_SQL, "op6_licenses": license_scan.OP6_SQL, "op8_mixing": mixing.OP8_SQL, "op9_exact_dedup": exact_dedup.OP9_SQL}
