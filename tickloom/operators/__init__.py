"""operators of the tick engine."""
