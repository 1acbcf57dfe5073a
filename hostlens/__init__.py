"""hostlens: host and process behaviour analytics as PySpark jobs."""
