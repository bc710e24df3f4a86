"""paperloom: document-intelligence analytics on Spark DataFrames."""
