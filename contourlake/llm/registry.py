"""The queries of this package and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from .ann import op8_ann
from .chat_format import OP6_SQL, op6_chat_format
from .language_id import op9_language_id
from .lm_score import op10_lm_score
from .mixing import op1_mixing
from .ngram_join import OP2_SQL, op2_ngram_join
from .piece_codec import op4_pieces
from .secrets import op7_secrets
from .sharding import op13_sharding
from .spelling import OP12_SQL, op12_spelling
from .url_filter import OP3_SQL, op3_url_filter
from .vector_dedup import OP5_SQL, op5_vector_dedup
from .whitening import op11_whitening

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_ngram_join": op2_ngram_join,
    "op3_url_filter": op3_url_filter,
    "op4_pieces": op4_pieces,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_secrets": op7_secrets,
    "op8_ann": op8_ann,
    "op9_language_id": op9_language_id,
    "op10_lm_score": op10_lm_score,
    "op11_whitening": op11_whitening,
    "op12_spelling": op12_spelling,
    "op13_sharding": op13_sharding,
}
ORACLE_SQL = {
    "op2_ngram_join": OP2_SQL,
    "op3_url_filter": OP3_SQL,
    "op5_vector_dedup": OP5_SQL,
    "op6_chat_format": OP6_SQL,
    "op12_spelling": OP12_SQL,
}
