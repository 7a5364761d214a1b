"""Queries of this subpackage, by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .decontamination import op1_decontamination
from .importance import SQL as IMPORTANCE_SQL
from .importance import op11_importance_resampling
from .jaccard_join import op2_ngram_jaccard
from .language_id import op6_language_id
from .line_dedup import SQL as LINE_SQL
from .line_dedup import op8_line_dedup
from .packing import op13_best_fit_packing
from .passages import op7_substring_dedup
from .pieces import op4_sentencepiece
from .pii import op3_pii
from .quality_classifier import op10_quality_classifier
from .quality_rules import op9_quality_rules
from .toxicity import op5_toxicity
from .variants import SQL as VARIANT_SQL
from .variants import op12_spelling_variants

QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_ngram_jaccard": op2_ngram_jaccard,
    "op3_pii": op3_pii,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_toxicity": op5_toxicity,
    "op6_language_id": op6_language_id,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_line_dedup": op8_line_dedup,
    "op9_quality_rules": op9_quality_rules,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_best_fit_packing": op13_best_fit_packing,
}

SQL: dict[str, str] = {"op8_line_dedup": LINE_SQL, "op11_importance_resampling": IMPORTANCE_SQL, "op12_spelling_variants": VARIANT_SQL}
