"""Operators of a training-data pipeline over documents and embeddings. Nothing else in the library imports them."""
