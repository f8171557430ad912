"""Report files."""
