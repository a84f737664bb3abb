"""Whole jobs and reports composed of operators."""
