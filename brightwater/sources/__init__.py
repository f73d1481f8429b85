"""Readers for the input tables."""
