"""Structured Streaming: task-stream dedup/routing and stream corruption with a frozen plan."""
