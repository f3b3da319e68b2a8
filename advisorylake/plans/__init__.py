"""Analytical reports composed from the operators."""
