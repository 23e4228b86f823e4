"""Readers for landed data and sinks for results."""
