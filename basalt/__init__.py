"""basalt: columnar scans, sort-reduce aggregation and vertex-centric graphs as Spark DataFrames."""
