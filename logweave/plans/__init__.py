"""End-to-end plans: log lines derived from tables, reports, and the registered workloads."""
