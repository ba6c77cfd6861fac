"""sources of peptrail."""
