"""Reading and writing documents, results and job tables."""
