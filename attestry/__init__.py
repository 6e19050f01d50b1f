"""attestry: directory provenance analytics as Spark DataFrame jobs."""
