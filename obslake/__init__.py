"""obslake: operational-record analytics as PySpark jobs."""
