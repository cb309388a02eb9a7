"""Spark-first engine for measuring whether a signal on intraday price bars carries an edge."""
