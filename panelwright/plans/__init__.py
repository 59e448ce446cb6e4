"""Compositions: stand-in inputs, the whole pipeline, the query catalogue."""
