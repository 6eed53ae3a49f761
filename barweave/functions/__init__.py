"""Part of the bar-series engine."""
