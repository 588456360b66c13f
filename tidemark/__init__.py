"""tidemark: corpus trend analytics as lazy PySpark plans."""
