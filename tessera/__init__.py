"""A warehouse-dialect SQL engine that binds queries to lazy Spark DataFrames."""
