"""Entity x time forecasting on Spark: clean, resample, featurise, backtest, report."""

__version__ = "0.1.0"
