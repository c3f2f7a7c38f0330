"""Court-event analytics on Spark: tracks, possession, screens and shots as DataFrame operators."""
