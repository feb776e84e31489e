"""Document processing on Spark DataFrames: readers, a block model, writers, layout, verification."""
