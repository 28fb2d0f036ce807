"""Reading, writing, naming and keeping tables."""
