"""Streaming forms. They have no batch counterpart in the reference and are extensions."""
