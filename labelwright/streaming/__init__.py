"""Continuous scanning and live trends."""

from .jobs import live_platforms, live_trends, read_labels, scan_stream, write_scan_stream

__all__ = ["live_platforms", "live_trends", "read_labels", "scan_stream", "write_scan_stream"]
