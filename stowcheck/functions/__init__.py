"""Column expressions built from Spark functions; no UDFs."""
