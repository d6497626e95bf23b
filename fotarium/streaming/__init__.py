"""Incremental forms: folds of logs that arrive file by file."""
