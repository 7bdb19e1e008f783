"""All queries for training data by name."""

from __future__ import annotations

from rankloom.llm import knn, leximin, packing, setjoin, split, termscore, tokenize, topn, toxicity

_MODULES = (topn, split, termscore, setjoin, leximin, knn, tokenize, packing, toxicity)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
