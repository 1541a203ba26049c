"""Part of callgauge: plans."""
