"""Training-data operators over the documents and embeddings tables. Nothing outside this folder imports it."""
