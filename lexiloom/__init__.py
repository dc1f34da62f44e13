"""Multilingual text analytics as DataFrame plans."""
