"""sinks of peptrail."""
