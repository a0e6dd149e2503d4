"""Incremental operation. The batch operators have no event time; this is an extension."""
