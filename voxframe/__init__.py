"""Analytics over time-stamped words, segments and intervals, declared as Spark plans."""
