"""Filter-and-aggregate pipelines compiled to DataFrames, and catalog commands."""
