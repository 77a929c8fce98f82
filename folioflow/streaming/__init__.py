"""Structured Streaming forms of the polling loops.

State changes are kept as an append-only log of update rows (file sink, exactly once); the current
table is a fold of base and log.  A micro-batch therefore writes what is new and never rewrites the
registry.  All streams run to the end of their input and stop (``availableNow``).
"""
