"""weftgraph: graph-learning analytics on Spark DataFrames."""
