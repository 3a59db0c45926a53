"""plumbline: a table-conformance engine on PySpark."""

__version__ = "0.1.0"
