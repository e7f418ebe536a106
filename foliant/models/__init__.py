"""Encoders and pair scorers as plug-ins."""
