"""Sources and sinks: request logs, record topics, change feeds, versioned tables."""
