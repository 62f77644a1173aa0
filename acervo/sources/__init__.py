"""Sources and file sinks."""
