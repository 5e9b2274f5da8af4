from .text import (WS, clean_piece, collapse_ws, digits_only, file_suffix, is_blank, is_upper,
                   py_strip, split_keep, splitlines)

__all__ = ["WS", "clean_piece", "collapse_ws", "digits_only", "file_suffix", "is_blank",
           "is_upper", "py_strip", "split_keep", "splitlines"]
