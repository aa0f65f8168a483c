"""Readers, writers, seeding and generation."""
