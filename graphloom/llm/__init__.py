"""Operators for corpora of text: names, tokens, mixtures and quality.  Nothing outside this package imports it."""
