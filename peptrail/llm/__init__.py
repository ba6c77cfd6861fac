"""Operators for text corpora: packing, mixing, sentence boundaries. Nothing outside this folder imports it."""
