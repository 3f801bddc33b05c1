"""Whole questions built from operators, each with the same in SQL."""
