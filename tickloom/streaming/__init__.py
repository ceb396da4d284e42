"""streaming of the tick engine."""
