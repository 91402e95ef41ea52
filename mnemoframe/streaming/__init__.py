"""Structured Streaming forms of the event, job, observation and session logs."""
