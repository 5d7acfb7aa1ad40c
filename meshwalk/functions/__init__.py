"""Expression language and math catalog."""
