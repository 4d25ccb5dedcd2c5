"""Structured Streaming: incremental clustering of vectors as their files arrive."""
