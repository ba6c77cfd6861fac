"""streaming of peptrail."""
