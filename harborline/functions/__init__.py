"""Part of harborline."""
