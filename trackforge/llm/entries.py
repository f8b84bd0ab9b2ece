"""The queries of the training-data operators and their SQL."""

from __future__ import annotations

from .jaccard import op3_jaccard_join
from .maxscore import OP6_SQL, op6_maxscore
from .mixing import op8_soft_mixing
from .packing import op2_pack
from .pii import op1_personal_data
from .quality import op7_quality_rules
from .secret_scan import op9_secret_forest
from .sharding import op10_karmarkar_karp
from .substrings import op4_sentence_spans
from .token_files import op5_token_files

QUERIES = {
    f.__name__: f
    for f in (op1_personal_data, op2_pack, op3_jaccard_join, op4_sentence_spans, op5_token_files, op6_maxscore, op7_quality_rules, op8_soft_mixing, op9_secret_forest, op10_karmarkar_karp)
}
SQL: dict[str, str] = {"op6_maxscore": OP6_SQL}
