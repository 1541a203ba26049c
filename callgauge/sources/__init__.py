"""Part of callgauge: sources."""
