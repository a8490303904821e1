"""Operators: profiling, issues, fixes, grain, charts and declared rules."""
