"""plans of the tick engine."""
