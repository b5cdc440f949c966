"""Structured Streaming jobs and stateful folds."""
