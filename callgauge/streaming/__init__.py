"""Part of callgauge: streaming."""
