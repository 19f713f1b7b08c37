"""tidemark: dated disclosure events, price bars and backtests as Spark DataFrame operators."""
