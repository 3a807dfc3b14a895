"""Reusable distributed plan shapes: prefix scans, look-back halos, keyed state, chunk models."""
