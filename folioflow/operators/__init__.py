"""Relational operators over the job table, and guarded extraction."""
