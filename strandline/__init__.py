"""Variant annotation as DataFrame programs."""
