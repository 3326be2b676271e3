"""Content-threat analytics and corpus operators expressed as Spark DataFrame transformations."""
