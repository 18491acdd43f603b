"""Evidence-bound, versioned facts and typed analytical queries, as Spark jobs."""
