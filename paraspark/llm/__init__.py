"""Operations of a training-data pipeline on documents, embeddings and conversations."""
