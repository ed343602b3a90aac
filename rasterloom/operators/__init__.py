"""DataFrame operators over chips, scenes, patches, embeddings and metric logs."""
