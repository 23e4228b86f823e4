"""Structured Streaming jobs; every sink is replay-safe."""
