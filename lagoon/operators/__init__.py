"""Distributed operators over series."""
