"""Maritime traffic analytics on Spark: DataFrame-to-DataFrame operators."""
