"""The operators over streams, and what has to be remembered between batches."""
