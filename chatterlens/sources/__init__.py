"""Reading and writing: files, message topics and partitioned tables."""
