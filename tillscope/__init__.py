"""Payment risk and revenue analytics as PySpark DataFrame operations."""

from tillscope.star import Star

__all__ = ["Star"]
