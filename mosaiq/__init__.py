"""Image and quality-evidence analytics as DataFrame operators."""
