"""Operators over bound tables."""
