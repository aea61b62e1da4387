"""The pipeline over streams: stateless chunking, deduplication, windows, and access times with bounded state."""
