"""Readers and writers of the files that users and services exchange, as Spark sources and sinks."""
