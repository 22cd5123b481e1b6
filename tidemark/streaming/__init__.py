"""Packet parsing, buffering, scoring and windows over streams."""
