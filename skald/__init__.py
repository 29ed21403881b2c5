"""Skald: DataFrame operators for conversational and narrative event logs."""

__version__ = "0.1.0"
