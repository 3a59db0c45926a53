"""Conformance of tables that grow."""
