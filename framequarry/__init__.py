"""framequarry: build and search deduplicated frame databases with Spark DataFrames."""
