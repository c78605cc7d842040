"""docgrid: structuring and verifying corpora of documents with Spark."""
