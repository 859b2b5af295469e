"""Column functions: typed ids, extraction, templates and search terms."""
