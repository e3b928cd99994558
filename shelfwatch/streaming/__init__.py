"""Structured Streaming jobs: ledger refresh, sessions, retention."""
