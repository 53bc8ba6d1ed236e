"""Column functions: projections that never shuffle."""
