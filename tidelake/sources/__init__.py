"""Reading, writing and maintaining stored series."""
