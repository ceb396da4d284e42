"""functions of the tick engine."""
