"""Operators for preparing training data: documents, pages and embeddings."""
