"""Document-processing analytics on Spark: catalog, job registry, text clean-up, extraction.

Everything is a ``DataFrame -> DataFrame`` or ``Column -> Column`` function, so Catalyst sees one
declarative plan.  Python code runs inside tasks only where Spark has no built-in: NFKC, a
caller-supplied line reorder, a caller-supplied extractor, and object reads/writes by key.
"""
