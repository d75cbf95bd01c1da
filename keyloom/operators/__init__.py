"""Operators over key/value entries."""
