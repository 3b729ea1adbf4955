"""tracemill: a Spark-first engine for auditing, selecting and preparing conversation and document corpora."""
