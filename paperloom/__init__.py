"""paperloom: a PySpark engine that turns business documents into validated records."""

__version__ = "0.1.0"
