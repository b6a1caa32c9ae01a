"""Readers and writers of tables, pages and uploads."""
