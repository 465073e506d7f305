"""The queries of this folder and their SQL, for the entry module."""

from __future__ import annotations

from .decontaminate import op9_decontaminate
from .language_id import op1_language_id
from .lm_score import op10_lm_score
from .packing import op8_best_fit_packing
from .quality import op3_pu_quality
from .secret_scan import OP6_SQL, op6_secret_scan
from .simhash import op4_simhash_dedup
from .token_counts import op7_token_counts
from .url_filter import OP5_SQL, op5_url_filter
from .vptree import OP2_SQL, op2_vp_tree_ann

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_vp_tree_ann": op2_vp_tree_ann,
    "op3_pu_quality": op3_pu_quality,
    "op4_simhash_dedup": op4_simhash_dedup,
    "op5_url_filter": op5_url_filter,
    "op6_secret_scan": op6_secret_scan,
    "op7_token_counts": op7_token_counts,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_decontaminate": op9_decontaminate,
    "op10_lm_score": op10_lm_score,
}

ORACLE_SQL = {
    "op2_vp_tree_ann": OP2_SQL,
    "op5_url_filter": OP5_SQL,
    "op6_secret_scan": OP6_SQL,
}
