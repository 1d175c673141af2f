"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .alignment import op11_alignment
from .chat import OP12_SQL, op12_chat
from .linededup import OP10_SQL, op10_line_dedup
from .merkle import OP13_SQL, op13_merkle
from .mixing import OP8_SQL, op8_mixing
from .neardup import op3_prob_minhash
from .neighbours import op6_neighbours
from .outliers import op1_robust_outliers
from .privacy import op4_private
from .quality import op9_quality
from .sentencepieces import op2_sentencepiece
from .tokencount import op5_token_counts
from .tokenfiles import op7_token_files

QUERIES = {
    "op1_robust_outliers": op1_robust_outliers,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_prob_minhash": op3_prob_minhash,
    "op4_private": op4_private,
    "op5_token_counts": op5_token_counts,
    "op6_neighbours": op6_neighbours,
    "op7_token_files": op7_token_files,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_line_dedup": op10_line_dedup,
    "op11_alignment": op11_alignment,
    "op12_chat": op12_chat,
    "op13_merkle": op13_merkle,
}
SQL = {
    "op8_mixing": OP8_SQL,
    "op10_line_dedup": OP10_SQL,
    "op12_chat": OP12_SQL,
    "op13_merkle": OP13_SQL,
}
