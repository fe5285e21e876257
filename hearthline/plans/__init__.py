"""Whole queries: compositions of the operators, and the registry of checked queries."""
