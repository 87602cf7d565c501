"""The queries of this subpackage over the given tables, and their SQL where DuckDB can express them."""

from .embedding_dedup import OP1_SQL, op1_embedding_dedup
from .html_extraction import op4_html_extraction
from .language_id import op9_language_id
from .line_dedup import OP6_SQL, op6_line_dedup
from .lm_scoring import op8_lm_score
from .metric_search import OP2_SQL, op2_mtree_topk
from .mixing import OP7_SQL, op7_mix_sources
from .packing import op5_best_fit_packing
from .periodic_runs import op12_periodic_runs
from .piece_codec import op13_sentencepiece
from .simhash_dedup import op3_simhash
from .token_alignment import op11_align_tokens
from .token_counts import op10_token_counts

QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_mtree_topk, op3_simhash, op4_html_extraction, op5_best_fit_packing, op6_line_dedup, op7_mix_sources, op8_lm_score, op9_language_id, op10_token_counts, op11_align_tokens, op12_periodic_runs, op13_sentencepiece)}

ORACLE_SQL: dict[str, str] = {"op1_embedding_dedup": OP1_SQL, "op2_mtree_topk": OP2_SQL, "op6_line_dedup": OP6_SQL, "op7_mix_sources": OP7_SQL}
