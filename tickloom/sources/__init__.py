"""sources of the tick engine."""
