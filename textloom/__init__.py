"""textloom: timed text and nested documents as Spark DataFrame pipelines."""
