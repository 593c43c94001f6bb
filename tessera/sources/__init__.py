"""Event logs and checkpoints as files that Spark reads and writes."""
