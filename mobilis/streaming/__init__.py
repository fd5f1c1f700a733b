"""Structured Streaming entry points.

The batch pipeline has no stream of its own; ride records arriving as files
can be scored incrementally with the same column operators, and the
per-(city, hour, weekend) ride features kept current (see ``rides_stream``).
"""
