"""Readers and writers for the ledger, rules, profiles and exports."""
