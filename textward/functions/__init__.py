"""Part of textward: see the README for what lives in functions."""
