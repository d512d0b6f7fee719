"""Wikitext extraction and corpus metrics as DataFrame operations."""
