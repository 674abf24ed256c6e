"""Structured Streaming entry points.

The reference has no streaming (no watermark, window or state).  The
row-wise operators (parsing, filters, prompt building, validity checks)
are plain column expressions, so they run unchanged on a streaming
DataFrame; this package wires the common one: newly arriving raw reaction
files -> clean reaction table.
"""
