"""The library's queries by name, each with its SQL where SQL can say it."""

from __future__ import annotations

from quillspark import registry
from quillspark.plans import answers, changes, documents, logs, namings, outlines, projects, ranges, reviews, scans, texts, trees, vectors, work, writings  # noqa: F401  they register their queries
from quillspark.streaming import folds, runs  # noqa: F401


def queries() -> dict[str, registry.Query]:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
