"""The registered query of each operator, and SQL for those SQL can express."""

from __future__ import annotations

from feedworks.llm.bpe import op6_byte_bpe
from feedworks.llm.brown import op2_class_lm
from feedworks.llm.curves import op13_nearest_vectors
from feedworks.llm.langid import op1_language_id
from feedworks.llm.mixing import op9_source_mixing
from feedworks.llm.neardup import op10_simhash_near_dedup
from feedworks.llm.nra import op12_ranked_search
from feedworks.llm.oracle import ORACLE
from feedworks.llm.pivots import op5_embedding_near_dedup
from feedworks.llm.quality import op4_quality_resampling
from feedworks.llm.repeats import op8_suffix_dedup
from feedworks.llm.simhash import op7_simhash_fingerprints
from feedworks.llm.tokenfiles import op3_token_id_files
from feedworks.llm.variants import op11_spelling_variants

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_class_lm,
        op3_token_id_files,
        op4_quality_resampling,
        op5_embedding_near_dedup,
        op6_byte_bpe,
        op7_simhash_fingerprints,
        op8_suffix_dedup,
        op9_source_mixing,
        op10_simhash_near_dedup,
        op11_spelling_variants,
        op12_ranked_search,
        op13_nearest_vectors,
    )
}

__all__ = ["ORACLE", "QUERIES"]
