"""Odd rows that every operator must take."""

#: Null id, null text, empty and blank texts, one word, repeated rows, ties.
ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (4, "word"), (None, "some text without an id of its own here"), (5, "\x00\x1f é   x"), (6, "a b c d e"), (7, "a b c d e")]
