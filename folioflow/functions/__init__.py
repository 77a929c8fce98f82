"""Scalar expressions: paths and keys, extracted text, display formats."""
