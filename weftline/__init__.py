"""weftline: web pages, file indexes and text corpora as Spark DataFrames."""
