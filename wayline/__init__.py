"""wayline: telemetry, trajectory and outage analytics as Spark DataFrame functions."""
