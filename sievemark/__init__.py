"""Report-quality, near-duplicate and training-data analytics as DataFrame transformations."""
