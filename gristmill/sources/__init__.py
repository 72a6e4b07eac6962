"""Readers of feeds, listings and pages."""
