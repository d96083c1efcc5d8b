"""Operators over the event table."""
