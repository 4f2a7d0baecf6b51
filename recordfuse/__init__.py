"""recordfuse: multi-source record resolution and fusion on Spark DataFrames."""
