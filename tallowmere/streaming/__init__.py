"""Structured Streaming forms of the keyed fold and of counts over the event log; an extension."""
