"""Query catalogue with its derived inputs and SQL."""
