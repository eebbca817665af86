"""One query per operator, over its whole table, and DuckDB SQL where that can express it."""

from .chat import OP4_SQL, op4_chat_format
from .decontaminate import OP3_SQL, op3_decontaminate
from .near_dedup import op8_near_duplicates
from .neighbours import op6_nearest_neighbours
from .quality import op5_quality
from .secret_scan import op9_secret_scan
from .sentence_pieces import op10_sentence_pieces
from .suffix_dedup import OP2_SQL, op2_suffix_dedup
from .token_rollup import op1_token_rollup
from .toxicity import op7_toxicity

QUERIES = {
    "op1_token_rollup": op1_token_rollup,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_chat_format": op4_chat_format,
    "op5_quality": op5_quality,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_toxicity": op7_toxicity,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_secret_scan": op9_secret_scan,
    "op10_sentence_pieces": op10_sentence_pieces,
}

ORACLE_SQL = {
    "op2_suffix_dedup": OP2_SQL,
    "op3_decontaminate": OP3_SQL,
    "op4_chat_format": OP4_SQL,
}
