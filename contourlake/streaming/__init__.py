"""Push: logs as streams."""
