"""Operators for preparing training corpora: filters, deduplication, extraction, tokens, packing."""
