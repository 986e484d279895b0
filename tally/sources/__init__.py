"""Table catalog and file profiles."""
