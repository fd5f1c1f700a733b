"""Readers and writers: feed files, stored tables, result sinks, test bindings."""
