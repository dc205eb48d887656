"""The subpackage's queries, by name, and the SQL of those that SQL can express on whole tables."""

from .bpe import op3_bpe
from .exact_dedup import OP6_SQL, op6_exact_dedup
from .licenses import op4_license
from .packing import op8_packing
from .passages import op5_passages
from .quality import op10_quality
from .simhash import op7_simhash
from .suffix_dedup import op9_suffix_dedup
from .topk import OP2_SQL, op2_topk
from .toxicity import op1_toxicity

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_topk": op2_topk,
    "op3_bpe": op3_bpe,
    "op4_license": op4_license,
    "op5_passages": op5_passages,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_simhash": op7_simhash,
    "op8_packing": op8_packing,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_quality": op10_quality,
}

ORACLE_SQL = {"op2_topk": OP2_SQL, "op6_exact_dedup": OP6_SQL}
