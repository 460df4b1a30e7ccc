"""Readers, tables and exports."""
