"""The corpus operators' queries and their SQL."""

from __future__ import annotations

from .exact_dedup import OP10_SQL, op10_exact_dedup
from .mixing import op8_pivotal_mix
from .packing import op5_best_fit_packing
from .pii import op2_pii_bilstm_crf
from .quality import op4_quality_divergence
from .secret_scan import op7_token_efficiency_secrets
from .sharding import op6_prefix_sum_shards
from .simhash import op9_simhash_near_dedup
from .token_files import op1_rans_token_files
from .warc import OP3_SQL, op3_warc_dictionary

QUERIES = {
    "op1_rans_token_files": op1_rans_token_files,
    "op2_pii_bilstm_crf": op2_pii_bilstm_crf,
    "op3_warc_dictionary": op3_warc_dictionary,
    "op4_quality_divergence": op4_quality_divergence,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_prefix_sum_shards": op6_prefix_sum_shards,
    "op7_token_efficiency_secrets": op7_token_efficiency_secrets,
    "op8_pivotal_mix": op8_pivotal_mix,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_exact_dedup": op10_exact_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_warc_dictionary": OP3_SQL,
    "op10_exact_dedup": OP10_SQL,
}
