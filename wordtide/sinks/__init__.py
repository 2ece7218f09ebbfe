"""sinks of the library."""
