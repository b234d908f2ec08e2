"""Reading and writing: topics, message decoding, stored tables, log streams."""
