"""A Spark-native equity-analytics library: bars, indicators, signals, screens, filings and quality checks."""
