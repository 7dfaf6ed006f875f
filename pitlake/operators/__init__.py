"""Row-level, table-level and point-in-time operators."""
