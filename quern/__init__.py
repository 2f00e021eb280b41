"""Search analytics on Spark DataFrames: indexing, ranking, extraction, maintenance, evaluation."""
