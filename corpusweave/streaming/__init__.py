"""Operators on corpora that keep arriving."""

from corpusweave.streaming.arrivals import append_rows, clean_chat, truncated_arrivals

__all__ = ["append_rows", "clean_chat", "truncated_arrivals"]
