"""tracemill: trace, dataset and report analytics written as Spark DataFrame plans."""
