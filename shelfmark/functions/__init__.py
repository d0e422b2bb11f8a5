"""Part of shelfmark."""
