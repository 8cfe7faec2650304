"""Registered query plans and their oracle SQL."""
