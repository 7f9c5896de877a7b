"""All registered queries of this subpackage: importing a module registers its own."""

from __future__ import annotations

import corpus_pipeline
from lakecheck.llm import chat, collocations, exact, idstore, mixing, packing, passages, quality, runs, secrets, simhash, tokencount, toxicity
from lakecheck.llm.registry import ORACLES, QUERIES

MODULES = (chat, collocations, exact, idstore, mixing, packing, passages, quality, runs, secrets, simhash, tokencount, toxicity)
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
__all__ = ["MODULES", "ORACLES", "QUERIES"]
