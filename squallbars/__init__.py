"""Event-driven market volatility analytics as Spark DataFrame operators."""
