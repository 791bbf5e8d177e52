"""Sources (ratings logs, driver tables) and sinks (scores, traces, run metadata)."""

from latentcf.sources.ratings import RATINGS_SCHEMA, RatingsRead, interactions, read_ratings, read_ratings_checked
from latentcf.sources.tables import (
    event_pairs,
    load_table,
    preview,
    profile,
    purchase_pairs,
    purchase_rows,
    word_pairs,
)

__all__ = [
    "RATINGS_SCHEMA",
    "RatingsRead",
    "read_ratings",
    "read_ratings_checked",
    "interactions",
    "load_table",
    "purchase_rows",
    "purchase_pairs",
    "word_pairs",
    "event_pairs",
    "profile",
    "preview",
]
