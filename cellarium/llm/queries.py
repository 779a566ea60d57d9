"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .clustering import OP13_SQL, op13
from .conversations import op12
from .decontamination import op4
from .exact_dedup import OP8_SQL, op8
from .html_extraction import op6
from .language_id import op3
from .license_scan import op5
from .line_dedup import OP1_SQL, op1
from .mixing import op2
from .near_dedup import op7
from .pii import op11
from .token_counts import op9
from .url_filter import OP10_SQL, op10

QUERIES = {
    "op1_line_dedup": op1,
    "op2_mixing": op2,
    "op3_language_id": op3,
    "op4_decontamination": op4,
    "op5_license_scan": op5,
    "op6_html_extraction": op6,
    "op7_near_dedup": op7,
    "op8_exact_dedup": op8,
    "op9_token_counts": op9,
    "op10_url_filter": op10,
    "op11_pii": op11,
    "op12_conversation_repair": op12,
    "op13_clustering": op13,
}
SQL = {
    "op1_line_dedup": OP1_SQL,
    "op8_exact_dedup": OP8_SQL,
    "op10_url_filter": OP10_SQL,
    "op13_clustering": OP13_SQL,
}
