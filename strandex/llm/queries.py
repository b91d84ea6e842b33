"""The corpus operators' queries, each over its whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from .op01_quality_rules import op1_quality_rules
from .op02_quality_mil import op2_quality_mil
from .op03_language import op3_language
from .op04_decontaminate import op4_decontaminate
from .op05_pii import op5_pii
from .op06_line_dedup import op6_line_dedup
from .op07_secrets import op7_secrets
from .op08_ngram_join import op8_ngram_join
from .op09_packing import op9_packing
from .op10_toxicity import op10_toxicity
from .op11_alignment import op11_alignment
from .op12_sharding import op12_sharding
from .op13_prefix_trie import op13_prefix_trie
from .sql import SQL

QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_quality_mil, op3_language, op4_decontaminate, op5_pii, op6_line_dedup, op7_secrets, op8_ngram_join, op9_packing, op10_toxicity, op11_alignment, op12_sharding, op13_prefix_trie,
    )
}
__all__ = ["QUERIES", "SQL"]
