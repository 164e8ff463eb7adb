"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from .ann import op1_adaptive_dimension_scan
from .langid import op2_hyperdimensional_language
from .media import op9_archive_media
from .ngram_join import ORACLE_SQL as JOIN_SQL
from .ngram_join import op6_ngram_jaccard_join
from .packing import op10_best_fit_packing
from .pieces import op4_prefix_table_pieces
from .pii import op7_random_field_pii
from .sharding import op8_histogram_shards
from .toxicity import op3_positive_unlabelled_toxicity
from .warc import ORACLE_SQL as WARC_SQL
from .warc import op5_revisit_resolution

QUERIES = {
    "op1_adaptive_dimension_scan": op1_adaptive_dimension_scan,
    "op2_hyperdimensional_language": op2_hyperdimensional_language,
    "op3_positive_unlabelled_toxicity": op3_positive_unlabelled_toxicity,
    "op4_prefix_table_pieces": op4_prefix_table_pieces,
    "op5_revisit_resolution": op5_revisit_resolution,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_random_field_pii": op7_random_field_pii,
    "op8_histogram_shards": op8_histogram_shards,
    "op9_archive_media": op9_archive_media,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {"op5_revisit_resolution": WARC_SQL, "op6_ngram_jaccard_join": JOIN_SQL}
