"""Readers and writers for the file kinds the engine understands."""
