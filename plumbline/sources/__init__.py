"""Delivered tables, specification files, run folders and working space."""
