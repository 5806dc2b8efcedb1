"""Sources, sinks and state: parquet, line protocol, brokers, snapshots."""
