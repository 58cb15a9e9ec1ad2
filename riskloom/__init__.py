"""Risk analytics on banking event data, as DataFrame-to-DataFrame operators."""
