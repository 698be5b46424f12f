"""Structured Streaming versions of the operators (file sources, availableNow triggers, checkpointed sinks)."""
