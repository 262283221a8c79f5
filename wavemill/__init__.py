"""Spark jobs for audio signals over whole corpora of recordings."""
