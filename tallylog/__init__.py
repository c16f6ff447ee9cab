"""A PySpark engine for log analytics."""
