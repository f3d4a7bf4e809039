"""newsloom: market news to scored trading signals, as Spark DataFrame jobs."""
