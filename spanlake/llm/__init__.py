"""Operators of a training-data pipeline over the tables documents, pages, embeddings,
benchmark and labels. Nothing else in the library imports this subpackage."""
