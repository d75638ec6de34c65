"""streaming of lodestone."""
