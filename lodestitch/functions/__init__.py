"""Part of lodestitch; see README.md."""
