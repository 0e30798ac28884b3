"""Quantity parsing on streams: every operator on spans is stateless, so a stream is parsed as a table is."""
