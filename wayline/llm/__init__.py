"""Training-data operators over documents and embeddings; nothing else in the library imports this."""
