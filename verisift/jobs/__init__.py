"""Jobs of the engine."""
