"""Streams: latches over message logs, count windows, and index maintenance by batch."""
