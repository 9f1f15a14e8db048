"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decontamination, flac, jaccard_join, line_dedup, packing, surrogates, token_store, toxicity, url_filter, warc

QUERIES = {
    "op1_surrogates": surrogates.query,
    "op2_url_filter": url_filter.query,
    "op3_jaccard_join": jaccard_join.query,
    "op4_line_dedup": line_dedup.query,
    "op5_decontamination": decontamination.query,
    "op6_flac": flac.query,
    "op7_toxicity": toxicity.query,
    "op8_token_store": token_store.query,
    "op9_warc": warc.query,
    "op10_packing": packing.query,
}
ORACLE_SQL = {"op4_line_dedup": line_dedup.SQL, "op9_warc": warc.SQL}
