"""Files, code structure and history as DataFrames."""
