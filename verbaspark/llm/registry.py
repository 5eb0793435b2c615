"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from verbaspark.llm.op1_jpeg import op1_progressive_jpeg
from verbaspark.llm.op2_chunks import op2_gear_chunks
from verbaspark.llm.op3_preference import SQL as PREFERENCE_SQL
from verbaspark.llm.op3_preference import op3_preference_pairs
from verbaspark.llm.op4_bpe import op4_two_tier_bpe
from verbaspark.llm.op5_divergence import op5_divergence_rules
from verbaspark.llm.op6_hilbert import op6_hilbert_packing
from verbaspark.llm.op7_ring import op7_bounded_ring
from verbaspark.llm.op8_secrets import op8_crf_secrets
from verbaspark.llm.op9_simhash import op9_simhash_components
from verbaspark.llm.op10_rans import op10_rans_ids

QUERIES = {
    f.__name__: f
    for f in (
        op1_progressive_jpeg, op2_gear_chunks, op3_preference_pairs, op4_two_tier_bpe, op5_divergence_rules,
        op6_hilbert_packing, op7_bounded_ring, op8_crf_secrets, op9_simhash_components, op10_rans_ids,
    )
}
ORACLES = {"op3_preference_pairs": PREFERENCE_SQL}
