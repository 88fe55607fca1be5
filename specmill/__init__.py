"""Record-quality analytics for large tables of machine-extracted engineering records, as Spark jobs."""
