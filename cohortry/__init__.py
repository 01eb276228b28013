"""Entity-table analytics on Spark: quality, splits, features, models, drift."""
