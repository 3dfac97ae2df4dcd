"""Mining operators over ratings, baskets, graphs, text and event streams, on Spark DataFrames."""
