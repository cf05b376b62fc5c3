"""Time-series operators: each takes a DataFrame, a SeriesSpec and options and returns a DataFrame."""
