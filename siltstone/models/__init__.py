"""Pluggable embedding and chat models."""
