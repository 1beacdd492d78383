"""Readers, contracts, snapshots and run logs."""
