"""Readers and writers of market tables."""
