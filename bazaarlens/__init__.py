"""Commerce-event analytics as Spark jobs: ingest, redact, project, reconcile, serve."""
