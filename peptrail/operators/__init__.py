"""operators of peptrail."""
