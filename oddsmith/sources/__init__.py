"""Loaders: CSV and JSON files into the canonical frames, and parsers of pages."""
