"""Readers, writers and source plug-ins."""
