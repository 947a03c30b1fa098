"""Part of marketloom; see the README for the map of modules."""
