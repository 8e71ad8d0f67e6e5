"""Functions on columns and on single texts."""
