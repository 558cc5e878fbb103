"""Catalogue sources and table sinks."""
