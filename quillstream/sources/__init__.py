"""Sources, sinks and session helpers."""
