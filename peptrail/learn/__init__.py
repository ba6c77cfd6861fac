"""learn of peptrail."""
