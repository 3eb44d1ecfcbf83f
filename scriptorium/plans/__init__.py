"""Composed query plans and the query catalogue."""
