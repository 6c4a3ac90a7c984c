"""The per-file operators over streams of arriving files."""
