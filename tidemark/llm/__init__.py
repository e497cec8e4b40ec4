"""Operators for building training corpora. Nothing else in tidemark imports this subpackage."""
