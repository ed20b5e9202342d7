"""Reports: every operator takes a DataFrame and returns DataFrames."""
