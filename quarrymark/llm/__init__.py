"""Operators that prepare a training corpus; nothing outside this folder imports them."""
