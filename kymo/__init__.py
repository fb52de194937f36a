"""Analytics over recordings on Spark."""
