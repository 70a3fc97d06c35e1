"""Structured Streaming forms of the resampling, session and residual operators."""
