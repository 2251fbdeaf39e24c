"""strandline: coastline geometry and coastal-change analytics on Spark DataFrames."""
