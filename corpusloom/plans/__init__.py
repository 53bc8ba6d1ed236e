"""Compositions of operators, the test fixture views and the query catalogue."""
