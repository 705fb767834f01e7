"""Derived inputs: forecasts computed from star-schema tables by integer arithmetic."""
