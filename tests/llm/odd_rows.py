"""Rows with the cases that every operator must bear."""

SHAPE = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(60_000))
ODD = [
    (0, None, "en", "a", None), (1, "", None, None, 0), (2, " \t\n", "en", "a", 3),
    (3, "one two three", "en", "a", 13), (4, "one  two\tthree", "en", None, 14),
    (4, "one  two\tthree", "en", None, 14), (None, "one two three", None, "b", 13),
    (5, LONG, "en", "b", len(LONG)), (6, LONG + " more", "en", "b", len(LONG) + 5),
    (7, "Über Straße ñandú \U0001F600 ça và", "de", "a", 27), (8, "Dup", "en", "a", 3),
    (9, "Dup", "en", "a", 3), (10, "Dup ", "en", "a", 4), (11, "12 34 !!", "en", "a", 8),
]


def rows_of(df):
    """Rows as comparable tuples, in a fixed order."""
    return sorted(map(repr, df.collect()))
