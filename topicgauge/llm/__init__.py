"""Operations of a training-data pipeline over documents and embeddings."""
