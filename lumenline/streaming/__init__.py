"""Online variants of the sequence operators."""
