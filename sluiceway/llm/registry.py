"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline
from sluiceway.llm import (
    decontamination, divergence, exact_dedup, html_text, itq, packing, pieces, quality, simhash, surrogates, tool_calls, turn_repair, warc,
)

_MODULES = (
    packing, warc, quality, exact_dedup, itq, simhash, pieces, html_text, tool_calls, surrogates, turn_repair, decontamination, divergence,
    corpus_pipeline,
)
QUERIES = {n: f for m in _MODULES for n, f in m.QUERIES.items()}
ORACLES = {n: s for m in _MODULES for n, s in m.ORACLES.items()}
