"""Part of callgauge: operators."""
