"""Runnable jobs: ``python -m jobs.<name> --config <file>``; each one's work is a function that takes a session."""
