"""Inputs and outputs: event preparation, derived tables, synthetic data, sinks."""
