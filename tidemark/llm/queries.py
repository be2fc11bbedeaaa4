"""The queries of this package and, where SQL can express one, its SQL for DuckDB."""

from tidemark.llm.exact_dedup import ORACLE as EXACT_DEDUP
from tidemark.llm.exact_dedup import op9_exact_dedup
from tidemark.llm.html_text import op4_html_text
from tidemark.llm.id_files import op1_token_id_files
from tidemark.llm.language_id import op3_language_id
from tidemark.llm.media import op5_media_columns
from tidemark.llm.near_dedup import op10_minhash_near_dedup
from tidemark.llm.packing import op6_sum_of_squares_packing
from tidemark.llm.periodic_runs import op13_periodic_runs
from tidemark.llm.phrases import ORACLE as COLLOCATIONS
from tidemark.llm.phrases import op11_phrase_collocations
from tidemark.llm.piece_viterbi import op8_piece_viterbi
from tidemark.llm.quality_rules import op7_quality_rules
from tidemark.llm.substring_dedup import op2_substring_dedup
from tidemark.llm.token_counts import op12_prefix_token_counts

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_id_files,
        op2_substring_dedup,
        op3_language_id,
        op4_html_text,
        op5_media_columns,
        op6_sum_of_squares_packing,
        op7_quality_rules,
        op8_piece_viterbi,
        op9_exact_dedup,
        op10_minhash_near_dedup,
        op11_phrase_collocations,
        op12_prefix_token_counts,
        op13_periodic_runs,
    )
}
ORACLE_SQL = {"op9_exact_dedup": EXACT_DEDUP, "op11_phrase_collocations": COLLOCATIONS}
