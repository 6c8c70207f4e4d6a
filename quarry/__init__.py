"""quarry: repository-intelligence analytics over DataFrames."""
