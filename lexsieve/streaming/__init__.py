"""streaming of the moderation engine."""
