"""Composite queries: views, submission, bundles, reports, batch and job runs."""
