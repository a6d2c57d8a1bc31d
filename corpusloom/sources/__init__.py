"""Readers, validation and corpus building."""
