"""Part of pairloom; see README.md."""
