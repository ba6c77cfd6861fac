"""functions of peptrail."""
