"""K-mer depth analysis and read-depth normalisation on Spark DataFrames."""
