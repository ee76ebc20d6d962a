"""Columns that stand for one entry: paths, sizes, times, labels."""
