"""tidewater: freight and shipping analytics as Spark DataFrame jobs."""

__all__ = ["config", "session"]
