"""glyphlake: multi-modal vector search and index maintenance as Spark DataFrame jobs."""
