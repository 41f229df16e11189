"""Telemetry analytics on Spark: detect, explain, decide, verify and learn as DataFrame jobs."""

__version__ = "0.1.0"
