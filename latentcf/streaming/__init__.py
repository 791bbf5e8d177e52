"""Structured Streaming adapters: arriving click files -> pairs / scores."""

from latentcf.streaming.clicks import append_pairs, dedup_pairs, read_ratings_stream, score_stream

__all__ = ["read_ratings_stream", "dedup_pairs", "append_pairs", "score_stream"]
