"""Evidence-checked document analysis as Spark jobs."""
