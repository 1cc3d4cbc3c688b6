"""The queries of the operators; each runs over its whole table with production parameters. SQL can't express any of them in full."""
from tidescan.llm import embedding_dedup, fingerprints, html_extract, jaccard_join, language_id, line_dedup, mixing, packing, quality, substring_dedup

QUERIES = {
    "op1_substring_dedup": substring_dedup.query, "op2_mixing": mixing.query, "op3_embedding_dedup": embedding_dedup.query, "op4_language_id": language_id.query,
    "op5_packing": packing.query, "op6_jaccard_join": jaccard_join.query, "op7_html_extract": html_extract.query, "op8_quality": quality.query,
    "op9_line_dedup": line_dedup.query, "op10_fingerprints": fingerprints.query,
}
SQL: dict[str, str] = {}
