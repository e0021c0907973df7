"""Reading and writing stores, corpora, vectors, examples and payloads."""
