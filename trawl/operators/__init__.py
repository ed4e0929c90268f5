"""Index building, retrieval, ranking and what follows ranking."""
