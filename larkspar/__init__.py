"""larkspar: analytics over catalogues of labelled media and their embedding vectors, as Spark DataFrames."""
