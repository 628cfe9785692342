"""Supply-planning table operators for Spark: DataFrame in, DataFrame out."""
