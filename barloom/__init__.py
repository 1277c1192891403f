"""Market-microstructure analytics on Spark: ticks to bars, bars to factors,
factors to information coefficients, quantile returns and long-short backtests."""
