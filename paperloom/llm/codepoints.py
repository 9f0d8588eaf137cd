"""Arrow text columns as numpy arrays of code points, under the name that the operators of this folder use."""

from paperloom.functions.codepoints import any_in, join, split, text

__all__ = ["any_in", "join", "split", "text"]
