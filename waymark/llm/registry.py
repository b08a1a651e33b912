"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from waymark.llm.decontaminate import op3_benchmark_decontamination
from waymark.llm.html_extract import op10_html_extraction
from waymark.llm.language_model import op9_lm_scoring
from waymark.llm.media import op5_media_columns
from waymark.llm.ngram_join import op2_ngram_jaccard_join
from waymark.llm.oracle import ORACLE_SQL  # noqa: F401
from waymark.llm.packing import op1_best_fit_packing
from waymark.llm.quality import op6_quality_classifier
from waymark.llm.secrets import op7_secret_scans
from waymark.llm.token_store import op4_token_store
from waymark.llm.url_filter import op8_url_filters

FOUND = (
    op1_best_fit_packing, op2_ngram_jaccard_join, op3_benchmark_decontamination, op4_token_store, op5_media_columns,
    op6_quality_classifier, op7_secret_scans, op8_url_filters, op9_lm_scoring, op10_html_extraction,
)
QUERIES = {f.__name__: f for f in FOUND}
