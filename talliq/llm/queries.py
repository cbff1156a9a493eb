"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op7_byte_bpe
from .decontamination import OP1_SQL, op1_decontamination
from .jaccard import OP10_SQL, op10_jaccard
from .langid import op5_language_id
from .licenses import OP3_SQL, op3_licenses
from .pii import op9_pii
from .quality import op4_quality
from .secrets import op6_secrets
from .substrings import op8_substrings
from .vectors import OP2_SQL, op2_topk

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_topk": op2_topk,
    "op3_licenses": op3_licenses,
    "op4_quality": op4_quality,
    "op5_language_id": op5_language_id,
    "op6_secrets": op6_secrets,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_substrings": op8_substrings,
    "op9_pii": op9_pii,
    "op10_jaccard": op10_jaccard,
}
ORACLES: dict[str, str] = {"op1_decontamination": OP1_SQL, "op2_topk": OP2_SQL, "op3_licenses": OP3_SQL, "op10_jaccard": OP10_SQL}
