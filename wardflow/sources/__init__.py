"""Readers and writers: files, nested documents, tables, JDBC and Kafka."""
