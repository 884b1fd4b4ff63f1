"""The numbered queries and the pipeline, and SQL for those that DuckDB can express on whole tables."""

from __future__ import annotations

from .bpe import op10_bpe
from .decontamination import op1_decontamination
from .language import op9_language_id
from .media import op3_gif_media
from .near_dedup import op4_near_dedup
from .prefix_trie import op11_prefix_trie
from .spelling import op13_spelling_variants
from .sql import ORACLE_SQL
from .suffix_dedup import op7_suffix_dedup
from .token_counts import op8_token_counts
from .token_files import op2_token_files
from .toxicity import op5_toxicity
from .warc import op6_warc
from .wrappers import op12_main_text

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_token_files": op2_token_files,
    "op3_gif_media": op3_gif_media,
    "op4_near_dedup": op4_near_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_warc": op6_warc,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_token_counts": op8_token_counts,
    "op9_language_id": op9_language_id,
    "op10_bpe": op10_bpe,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_main_text": op12_main_text,
    "op13_spelling_variants": op13_spelling_variants,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
