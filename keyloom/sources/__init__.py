"""Sources and sinks of key/value entries."""
