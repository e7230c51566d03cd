"""Queries of this subpackage, by name."""

from __future__ import annotations

from .decontaminate import op4_decontamination
from .line_dedup import op8_line_dedup
from .ngram_join import op5_ngram_join
from .packing import op1_packing
from .pii import op9_pii
from .quality_classifier import op10_quality_classifier
from .quality_rules import op2_quality_rules
from .secret_scan import op7_secret_scan
from .token_counts import op3_token_counts
from .warc import ORACLE as WARC_SQL
from .warc import op6_warc

QUERIES = {
    "op1_packing": op1_packing,
    "op2_quality_rules": op2_quality_rules,
    "op3_token_counts": op3_token_counts,
    "op4_decontamination": op4_decontamination,
    "op5_ngram_join": op5_ngram_join,
    "op6_warc": op6_warc,
    "op7_secret_scan": op7_secret_scan,
    "op8_line_dedup": op8_line_dedup,
    "op9_pii": op9_pii,
    "op10_quality_classifier": op10_quality_classifier,
}
ORACLES: dict[str, str] = {"op6_warc": WARC_SQL}
