"""By-name file ingestion, entity catalogue, file inventory and sinks."""
