"""Streams of activity."""
