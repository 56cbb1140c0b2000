"""Typed scans, payload parsing, webhook drop folders and dated snapshots."""
