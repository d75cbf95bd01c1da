"""keyloom: a key/value store and query engine expressed in Spark DataFrames."""
