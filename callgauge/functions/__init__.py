"""Part of callgauge: functions."""
