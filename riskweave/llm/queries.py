"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import quality_rules, spelling_variants, url_filters, vector_codes, vector_neardup, warc_bundles
from .context_tree import op8_context_tree
from .decontamination import op3_decontamination
from .language_id import op2_language_id
from .line_templates import op5_line_templates
from .piece_transducer import op9_piece_transducer
from .quality_rules import op1_quality_rules
from .simhash_neardup import op6_simhash_neardup
from .spelling_variants import op13_spelling_variants
from .token_counts import op10_token_counts
from .url_filters import op4_url_filters
from .vector_codes import op11_vector_codes
from .vector_neardup import op12_vector_neardup
from .warc_bundles import op7_warc_bundles


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_quality_rules, op2_language_id, op3_decontamination, op4_url_filters, op5_line_templates, op6_simhash_neardup, op7_warc_bundles, op8_context_tree, op9_piece_transducer, op10_token_counts, op11_vector_codes, op12_vector_neardup, op13_spelling_variants]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    found = {"op1_quality_rules": quality_rules.oracle(), "op4_url_filters": url_filters.oracle(), "op7_warc_bundles": warc_bundles.oracle()}
    return found | {"op11_vector_codes": vector_codes.oracle(), "op12_vector_neardup": vector_neardup.oracle(), "op13_spelling_variants": spelling_variants.oracle()}
