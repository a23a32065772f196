"""Readers and writers for line logs, snapshots and label maps."""
