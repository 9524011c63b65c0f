"""Panel analytics on Spark: ranking, growth, movement and comparison of entity x metric x year panels."""
