"""plans of peptrail."""
