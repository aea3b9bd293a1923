"""Storage providers, metadata lines and the catalog of indexes."""
