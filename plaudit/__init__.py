"""Customer-review analytics on Spark: DataFrame in, DataFrame out."""
