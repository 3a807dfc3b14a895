"""tidemark: learning from, scoring and auditing labelled data streams on Spark."""
