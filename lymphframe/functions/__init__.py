"""Part of lymphframe; see the README for the map of modules."""
