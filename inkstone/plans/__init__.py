"""End-to-end jobs that users call."""
