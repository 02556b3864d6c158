"""Operators that make training data for language models out of documents, pages and vectors."""
