"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .bpe import op8_bpe
from .fmindex import OP13_SQL, op13_decontamination
from .merkle import OP11_SQL, op11_merkle
from .minhash import op7_minhash
from .ordering import op1_training_order
from .packing import op6_packing
from .quality import op10_quality
from .spotsigs import op3_spotsigs
from .substrings import op5_substrings
from .toolcalls import op9_toolcalls
from .toxicity import op2_toxicity
from .trie import OP12_SQL, op12_trie
from .warc import OP4_SQL, op4_revisits

QUERIES = {
    "op1_training_order": op1_training_order,
    "op2_toxicity": op2_toxicity,
    "op3_spotsigs": op3_spotsigs,
    "op4_revisits": op4_revisits,
    "op5_substrings": op5_substrings,
    "op6_packing": op6_packing,
    "op7_minhash": op7_minhash,
    "op8_bpe": op8_bpe,
    "op9_toolcalls": op9_toolcalls,
    "op10_quality": op10_quality,
    "op11_merkle": op11_merkle,
    "op12_trie": op12_trie,
    "op13_decontamination": op13_decontamination,
}
ORACLE_SQL: dict[str, str] = {"op4_revisits": OP4_SQL, "op11_merkle": OP11_SQL, "op12_trie": OP12_SQL, "op13_decontamination": OP13_SQL}
