"""Analytics over irregular time series, vectors and token counts, as Spark DataFrame operators."""
