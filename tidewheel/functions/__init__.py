"""Column-level functions: typed absence, durations, rule expressions."""
