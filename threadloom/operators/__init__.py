"""Plans over DataFrames; each function maps DataFrames to a DataFrame."""
