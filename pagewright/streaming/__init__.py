"""Stateful folds, as batch folds and as Structured Streaming operators."""
