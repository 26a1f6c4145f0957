"""One module per family of operators; each takes and returns DataFrames."""
