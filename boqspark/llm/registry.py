"""The queries of this subpackage and their DuckDB forms."""

from __future__ import annotations

from .chat_format import op2_chat_format
from .chunk_store import op7_chunk_store
from .jaccard_join import op6_jaccard_join
from .language_model import op4_language_model
from .lexical_search import OP11_SQL, op11_lexical_search
from .packing import op9_packing
from .periodic_runs import op13_periodic_runs
from .quality_rules import op3_quality_rules
from .sp_codec import op1_sentencepiece
from .substring_dedup import op8_substring_dedup
from .suffix_dedup import op12_suffix_dedup
from .url_filter import OP5_SQL, op5_url_filter
from .vector_search import op10_vector_search

QUERIES = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_chat_format": op2_chat_format,
    "op3_quality_rules": op3_quality_rules,
    "op4_language_model": op4_language_model,
    "op5_url_filter": op5_url_filter,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_chunk_store": op7_chunk_store,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_packing": op9_packing,
    "op10_vector_search": op10_vector_search,
    "op11_lexical_search": op11_lexical_search,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_periodic_runs": op13_periodic_runs,
}
ORACLE = {"op5_url_filter": OP5_SQL, "op11_lexical_search": OP11_SQL}
