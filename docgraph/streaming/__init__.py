"""Collections and graphs that follow a stream."""
