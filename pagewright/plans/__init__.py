"""The workloads: operators put together."""
