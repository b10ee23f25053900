"""Sources and sinks (§2.1)."""
