"""Structured Streaming intake operators."""
