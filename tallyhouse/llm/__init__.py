"""Operations of a training-data pipeline: deduplication, filters, scans, archives, packing and search."""
