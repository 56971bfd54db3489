"""Queries of this subpackage by name, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from .decontaminate import op3_decontaminate
from .exact_dedup import OP7_SQL, op7_exact_dedup
from .kd_shards import op5_kd_sharding
from .language_id import op8_language_id
from .license_scan import op10_license_scan
from .packing import op9_packing
from .pii import op4_pii
from .secret_scan import op1_secret_scan
from .simhash import op6_simhash
from .span_dedup import op2_span_dedup

QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_span_dedup": op2_span_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_pii": op4_pii,
    "op5_kd_sharding": op5_kd_sharding,
    "op6_simhash": op6_simhash,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_language_id": op8_language_id,
    "op9_packing": op9_packing,
    "op10_license_scan": op10_license_scan,
}
ORACLES = {
    "op7_exact_dedup": OP7_SQL,
}
