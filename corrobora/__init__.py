"""Evidence analytics on Spark: DataFrame operators over claims and the evidence behind them."""
