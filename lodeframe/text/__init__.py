"""From documents to blocks, chunks, passages and summaries."""
