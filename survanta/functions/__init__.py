"""Column functions: they take and return ``Column`` and never start a job."""
