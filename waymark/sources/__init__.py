"""Readers of pages, JSON payloads and tables, and writers of exports and merged tables."""
