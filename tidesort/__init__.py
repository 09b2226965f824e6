"""tidesort: ordering, merging and de-duplicating data sets larger than memory, planned as Spark DataFrames."""
