"""Composite plans: normalizers, linkers, seeding, and the run over all of them."""
