"""Part of the key-value log engine; see README.md."""
