"""Whole research jobs composed from the operators."""
