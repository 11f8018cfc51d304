"""Readers: the raw landing table, paged HTTP sources, version listings, profiles."""
