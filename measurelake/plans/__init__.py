"""Relational dataflows: evaluation against a gold corpus, and the build of unit lookups."""
