"""Relational operators over the message model: search, listing, upserts, synchronisation."""
