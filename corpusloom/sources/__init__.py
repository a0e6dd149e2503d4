"""Readers: bytes or text of many documents to rows of the node table."""
