"""Row-local cleaning on streaming DataFrames."""
