"""Independent SQL statements of the same results, for checking in another database."""
