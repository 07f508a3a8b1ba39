"""Streaming forms of the operators; each ends in the state of its batch form."""
