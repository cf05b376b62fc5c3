"""Time-series and document analytics expressed as lazy PySpark DataFrame plans."""
