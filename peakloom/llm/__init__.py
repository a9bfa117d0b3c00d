"""Operators for preparing training text: dedup, mixing, chat, PII, packing, output."""
