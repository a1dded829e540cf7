"""The subpackage's registered queries and their DuckDB SQL."""

from __future__ import annotations

from .bm25 import OP9_SQL, op9_bm25
from .edit_counts import op6_edit_counts
from .exact_dedup import OP12_SQL, op12_exact_dedup
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .html_blocks import op2_html_blocks
from .langid import op7_langid
from .mixing import OP5_SQL, op5_mixing
from .packing import op8_packing
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .simhash import op3_simhash
from .suffix_dedup import op10_suffix_dedup
from .syncmers import op1_syncmers
from .token_records import op4_token_records

REGISTRY = {
    "op1_syncmers": op1_syncmers,
    "op2_html_blocks": op2_html_blocks,
    "op3_simhash": op3_simhash,
    "op4_token_records": op4_token_records,
    "op5_mixing": op5_mixing,
    "op6_edit_counts": op6_edit_counts,
    "op7_langid": op7_langid,
    "op8_packing": op8_packing,
    "op9_bm25": op9_bm25,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {
    "op5_mixing": OP5_SQL,
    "op9_bm25": OP9_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_exact_dedup": OP12_SQL,
    "op13_hard_negatives": OP13_SQL,
}
