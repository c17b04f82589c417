"""weftlake: web-content analytics as PySpark DataFrame operators."""
