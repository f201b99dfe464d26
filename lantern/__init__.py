"""lantern: evidence retrieval, verification and corpus metrics as Spark DataFrame operations."""
