"""Session-log search, recall and corpus operators on Spark DataFrames."""
