"""Structured Streaming form of the load job (files arriving in a folder)."""
