"""Record-linkage and data-quality engine for PySpark."""
