"""Operators on DataFrames: keys, alignment, comparison, roll-ups, detection, catalogue, log."""
