"""Operators for training data: sketches, top lists, tokenizing, packing and repair of garbled text.

Nothing outside this subpackage imports it."""
