"""Record columns, options and small column functions."""
