"""Index tables on storage."""
