"""All queries and oracle SQL of the subpackage."""

from __future__ import annotations

from . import embeddup, langid, linededup, lm, mixing, packing, simhash, topk, toxicity, urlfilter

MODULES = (toxicity, packing, linededup, langid, lm, embeddup, mixing, urlfilter, simhash, topk)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in MODULES for k, s in m.ORACLE.items()}
