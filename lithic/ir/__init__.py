"""Per-function programs: expressions from instructions, rewrites, and text. One function is one unit of work."""
