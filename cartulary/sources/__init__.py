"""Where tables, catalog tables and cached responses are read from and written to."""
