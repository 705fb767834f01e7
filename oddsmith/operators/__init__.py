"""Scoring, ranking, calibration, replay and diagnostics as DataFrame operators."""
