"""Bytes of tiles: small encoders that run inside tasks, one tile at a time."""
