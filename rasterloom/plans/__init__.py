"""Reusable plan shapes: skew-proof ranking, salted joins, grids, scratch tables."""
