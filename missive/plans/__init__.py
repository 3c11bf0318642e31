"""Search terms, filters and page cursors as values."""
