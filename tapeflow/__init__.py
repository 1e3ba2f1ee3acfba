"""Market-data operators for Spark: trades and book updates in, candles, flow
metrics, features, labels, signals and reports out. Every operator takes and
returns DataFrames; one job serves all products."""
