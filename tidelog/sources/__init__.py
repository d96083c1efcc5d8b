"""Reading and writing event tables."""
