"""User-level reports built from the operators."""
