"""The registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from .bpe import op3_byte_bpe
from .chat import OP9_SQL, op9_preference_formatting
from .decontaminate import OP10_SQL, op10_decontaminate
from .divergence import OP11_SQL, op11_source_divergence
from .embedding_dedup import OP12_SQL, op12_embedding_dedup
from .fingerprints import op1_document_fingerprints
from .hard_negatives import OP13_SQL, op13_hard_negatives
from .html_extract import op4_html_extraction
from .language_model import op7_language_model
from .licenses import op2_license_scan
from .near_duplicates import op6_ngram_jaccard_join
from .toxicity import op5_toxicity
from .url_filter import OP8_SQL, op8_url_filter

QUERIES: dict = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_license_scan": op2_license_scan,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_html_extraction": op4_html_extraction,
    "op5_toxicity": op5_toxicity,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_language_model": op7_language_model,
    "op8_url_filter": op8_url_filter,
    "op9_preference_formatting": op9_preference_formatting,
    "op10_decontaminate": op10_decontaminate,
    "op11_source_divergence": op11_source_divergence,
    "op12_embedding_dedup": op12_embedding_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLE_SQL: dict[str, str] = {"op8_url_filter": OP8_SQL, "op9_preference_formatting": OP9_SQL, "op10_decontaminate": OP10_SQL, "op11_source_divergence": OP11_SQL, "op12_embedding_dedup": OP12_SQL, "op13_hard_negatives": OP13_SQL}
