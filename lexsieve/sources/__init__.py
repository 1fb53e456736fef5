"""sources of the moderation engine."""
