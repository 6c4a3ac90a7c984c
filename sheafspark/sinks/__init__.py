"""Writers for documents and summary tables."""
