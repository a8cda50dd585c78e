"""Object-inventory reconciliation and backup-health analytics on Spark."""
