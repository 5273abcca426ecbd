"""All queries on the star-schema tables: their Spark form, and the SQL that checks each."""

from tickforge.plans import adapters, checks, filings, incremental, ledger, objects, passages, picks, published, quant, reported, scalars, screening, screens, state, technical, text, titles
from tickforge.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "adapters", "checks", "filings", "incremental", "ledger", "objects", "passages", "picks", "published", "quant", "reported", "scalars", "screening", "screens", "state", "technical", "text", "titles"]
