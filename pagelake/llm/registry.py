"""The queries of this subpackage and the SQL that some of them can be held against."""

from __future__ import annotations

import corpus_pipeline

from . import branches, decontaminate, fingerprints, lines, near, packing, pivots, quotes, suffixes, toxicity, tries, urls, warc

_MODULES = (urls, suffixes, quotes, decontaminate, near, toxicity, warc, fingerprints, packing, lines, branches, tries, pivots)

QUERIES = {k: f for m in _MODULES for k, f in m.QUERIES.items()} | {"pipeline": corpus_pipeline.run}
ORACLE_SQL = {k: sql for m in _MODULES for k, sql in getattr(m, "ORACLE_SQL", {}).items()}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
