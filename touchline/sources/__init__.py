"""Readers and write modes: tables, CSV snapshots, stored pages, the schema catalog."""
