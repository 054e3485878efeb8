"""Operators over event, score and label frames: features, scoring, graph, calibration, alerts."""
