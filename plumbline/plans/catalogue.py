"""The registered queries of the library and the SQL that they are held against."""

from __future__ import annotations

from plumbline.plans import claims, corpus, costs, diagnosis, graphs, legal, more, pipelines, retrieval, statistics, surface

_PARTS = (retrieval, statistics, claims, diagnosis, corpus, graphs, pipelines, more, costs, legal, surface)
QUERIES: dict = {name: f for part in _PARTS for name, f in part.QUERIES.items()}
ORACLE: dict = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
