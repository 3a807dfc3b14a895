"""User-level operators; each takes DataFrames and returns DataFrames."""
