"""veridoc: document, retrieval and compliance analytics on Spark DataFrames."""
