"""The queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from .bpe import op8_bpe
from .jaccard import op7_jaccard
from .langid import op10_langid
from .mixing import OP6_SQL, op6_mixing
from .quality import op3_quality
from .sharding import op4_sharding
from .substring import op5_substring
from .topk import OP2_SQL, op2_topk
from .toxicity import op9_toxicity
from .warc import OP1_SQL, op1_warc


def queries() -> dict:
    return {
        "op1_warc": op1_warc,
        "op2_topk": op2_topk,
        "op3_quality": op3_quality,
        "op4_sharding": op4_sharding,
        "op5_substring": op5_substring,
        "op6_mixing": op6_mixing,
        "op7_jaccard": op7_jaccard,
        "op8_bpe": op8_bpe,
        "op9_toxicity": op9_toxicity,
        "op10_langid": op10_langid,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op2_topk": OP2_SQL, "op6_mixing": OP6_SQL}
