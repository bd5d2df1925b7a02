"""The analyses. Every function takes DataFrames and returns a lazy DataFrame."""
