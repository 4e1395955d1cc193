"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import oracles
from .chat import op5_chat
from .decontaminate import op8_decontamination
from .editprints import op9_fingerprints
from .htmltext import op10_html_text
from .line_dedup import op7_line_dedup
from .near_dups import op6_near_dups
from .secret_scan import op4_secrets
from .sentencepieces import op3_sentencepiece
from .toxicity import op1_toxicity
from .warc import op2_warc

QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_warc": op2_warc,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_secrets": op4_secrets,
    "op5_chat": op5_chat,
    "op6_near_dups": op6_near_dups,
    "op7_line_dedup": op7_line_dedup,
    "op8_decontamination": op8_decontamination,
    "op9_fingerprints": op9_fingerprints,
    "op10_html_text": op10_html_text,
}
#: The others score with fitted models, search for links or walk trees, and are tested against brute force.
ORACLES: dict[str, str] = {
    "op2_warc": oracles.WARC,
    "op4_secrets": oracles.SECRETS,
    "op5_chat": oracles.CHAT,
    "op7_line_dedup": oracles.LINES,
}
