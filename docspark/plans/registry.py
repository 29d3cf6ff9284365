"""All queries of the library by name, and their SQL."""

from __future__ import annotations

from docspark.plans import catalog, classify, clean, datasets, extract, gates, models, ocr, rules, select, text

MODULES = (text, ocr, classify, extract, clean, rules, select, catalog, gates, models, datasets)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
