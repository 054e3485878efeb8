"""Structured Streaming jobs: windowed features, duplicates, keyed alert state.  An extension of the batch operators."""
