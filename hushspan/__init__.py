"""hushspan: finding and redacting identifying text in tables of documents, on Spark."""
