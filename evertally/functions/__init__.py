"""Column functions: identity, validation and record contracts."""
