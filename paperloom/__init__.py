"""paperloom: document-archive analytics on Spark DataFrames."""
