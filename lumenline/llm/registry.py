"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import base
from .decontamination import OP3_SQL, op3_prefix_decontamination
from .jaccard import OP4_SQL, op4_count_vector_join
from .licenses import op6_template_markup
from .linededup import OP5_SQL, op5_deletion_neighbourhood
from .packing import op9_histogram_packing
from .preference import op2_preference_pairs
from .prefixtrie import OP11_SQL, op11_prefix_trie
from .quality import op7_controlled_thresholds
from .repair import OP13_SQL, op13_rank_repair
from .sharding import op1_sampled_splitters
from .substring import OP8_SQL, op8_rabin_karp
from .tokencounts import op12_prefix_token_counts
from .toxicity import op10_nearest_examples

QUERIES = {
    f.__name__: f
    for f in (
        op1_sampled_splitters,
        op2_preference_pairs,
        op3_prefix_decontamination,
        op4_count_vector_join,
        op5_deletion_neighbourhood,
        op6_template_markup,
        op7_controlled_thresholds,
        op8_rabin_karp,
        op9_histogram_packing,
        op10_nearest_examples,
        op11_prefix_trie,
        op12_prefix_token_counts,
        op13_rank_repair,
    )
}
ORACLE_SQL: dict[str, str] = {op3_prefix_decontamination.__name__: OP3_SQL, op4_count_vector_join.__name__: OP4_SQL, op5_deletion_neighbourhood.__name__: OP5_SQL, op8_rabin_karp.__name__: OP8_SQL, op11_prefix_trie.__name__: OP11_SQL, op13_rank_repair.__name__: OP13_SQL}
# What SQL can express of the others.
QUERIES |= base.QUERIES
ORACLE_SQL |= base.SQL
