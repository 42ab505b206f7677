"""Registry of the corpus queries and of the SQL that checks them."""

from __future__ import annotations

from . import bestfit, exact_dedup, lexical, license_scan, mixing, near_dedup, packing, pii, quality, sharding, topk, url_filter, vector_codes

QUERIES = {
    "op1_packing": packing.op1,
    "op2_mixing": mixing.op2,
    "op3_quality": quality.op3,
    "op4_near_dedup": near_dedup.op4,
    "op5_topk": topk.op5,
    "op6_sharding": sharding.op6,
    "op7_pii": pii.op7,
    "op8_url_filter": url_filter.op8,
    "op9_license_scan": license_scan.op9,
    "op10_exact_dedup": exact_dedup.op10,
    "op11_bestfit": bestfit.op11,
    "op12_lexical": lexical.op12,
    "op13_vector_codes": vector_codes.op13,
}
ORACLES = {"op4_near_dedup": near_dedup.OP4_SQL, "op5_topk": topk.OP5_SQL, "op10_exact_dedup": exact_dedup.OP10_SQL, "op12_lexical": lexical.OP12_SQL, "op13_vector_codes": vector_codes.OP13_SQL}
