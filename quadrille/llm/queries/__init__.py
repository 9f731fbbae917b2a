"""One module for each query: NAME, query(spark, sf_dir) and SQL (None where SQL can't express it)."""
