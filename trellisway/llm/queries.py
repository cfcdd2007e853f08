"""Registered queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from .alignment import op12_token_alignment
from .importance import OP13_SQL, op13_importance_resampling
from .language import op3_language_id
from .lines import op6_line_dedup
from .media import op10_media
from .minhash import OP1_SQL, op1_minhash_dedup
from .packing import op9_packing
from .pii import op4_pii
from .quality import op5_quality
from .tokencount import op2_token_counts
from .topk import OP11_SQL, op11_topk_search
from .toxicity import op7_toxicity
from .wordbpe import op8_bpe

QUERIES = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_language_id": op3_language_id,
    "op4_pii": op4_pii,
    "op5_quality": op5_quality,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_bpe": op8_bpe,
    "op9_packing": op9_packing,
    "op10_media": op10_media,
    "op11_topk_search": op11_topk_search,
    "op12_token_alignment": op12_token_alignment,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL = {
    "op1_minhash_dedup": OP1_SQL,
    "op11_topk_search": OP11_SQL,
    "op12_token_alignment": op12_token_alignment,
    "op13_importance_resampling": OP13_SQL,
}
