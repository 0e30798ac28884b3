"""Readers of ontologies, surface lists, annotated corpora and result files, and writers of lookups."""
