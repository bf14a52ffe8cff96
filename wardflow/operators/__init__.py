"""User-level operators over DataFrames."""
