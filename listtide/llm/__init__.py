"""Operators of a training-data pipeline, with their registered queries and SQL."""

from .audit import OP13_SQL, op13_filter_audit
from .bpe import op8_bpe
from .contamination import OP7_SQL, op7_decontamination
from .jaccard import OP1_SQL, op1_jaccard_join
from .langid import op6_language_id
from .mixing import op12_lm_score
from .pseudonyms import op2_pseudonyms
from .quality import op4_quality_rules
from .repeats import OP3_SQL, op3_suffix_dedup
from .search import OP11_SQL, op11_lexical_search
from .secrets import op5_secret_scan
from .sharding import op9_sharding
from .toxicity import op10_toxicity

QUERIES = {
    "op1_jaccard_join": op1_jaccard_join,
    "op2_pseudonyms": op2_pseudonyms,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_quality_rules": op4_quality_rules,
    "op5_secret_scan": op5_secret_scan,
    "op6_language_id": op6_language_id,
    "op7_decontamination": op7_decontamination,
    "op8_bpe": op8_bpe,
    "op9_sharding": op9_sharding,
    "op10_toxicity": op10_toxicity,
    "op11_lexical_search": op11_lexical_search,
    "op12_lm_score": op12_lm_score,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES = {
    "op1_jaccard_join": OP1_SQL,
    "op3_suffix_dedup": OP3_SQL,
    "op7_decontamination": OP7_SQL,
    "op11_lexical_search": OP11_SQL,
    "op13_filter_audit": OP13_SQL,
}
