"""Small documents with the odd cases every operator must stand: nulls, empty and long
texts, other scripts, ties, repeated rows and extra columns with clashing names."""

from __future__ import annotations

from collections import Counter

KEY = "AKIA" + "ABCDEFGH12345678"
SHARED_HEX = "0123456789abcdef0123456789abcdef"
OWN_TOKEN = "ghp_ownedBy1Person2Only3Times4"
COPIED_TOKEN = "sk_example_9f8e7d6c5b4a3a2b1c"

ROWS = [
    (1, "The quick brown fox jumps over the lazy dog.\nThe end.", "en", "a"),
    (2, "", "en", "b"),
    (3, None, "en", "b"),
    (4, "Hello  World\t\u00a0 caf\u00e9 \U0001f600\U0001f600 it's 123 don't!! \n\n x ", "en", "c"),
    (5, f"é\U0001f600 password: hunter2secret token=ab {KEY} and {SHARED_HEX}", "en", "a"),
    (6, f"api_key = \"{SHARED_HEX}\" {OWN_TOKEN} password: token:abcdefgh", "de", "b"),
    (7, f"{COPIED_TOKEN} one", "en", "a"),
    (8, f"two {COPIED_TOKEN}", "en", "b"),
    (9, f"three {COPIED_TOKEN} {OWN_TOKEN}", "de", "b"),
    (10, f"four {COPIED_TOKEN}", "de", None),
    (11, "ab" * 3000 + " " + "word " * 2000, "en", "a"),
    (12, "same text here", "en", "a"),
    (12, "same text here", "en", "a"),
    (13, "same text here", None, "c"),
    (None, "a row without an id", "en", "a"),
    (14, "\x1c\x85 odd\u2003spaces\x0bhere\x1f ", "en", "a"),
]


def docs(spark, rows=None):
    """``documents`` with extra columns whose names clash with outputs."""
    rows = ROWS if rows is None else rows
    return spark.createDataFrame(
        [(*r, len(r[1] or ""), 7, "x", "y", -1) for r in rows],
        "doc_id long, text string, lang string, source string, n_chars long, "
        "n_tokens int, spans string, fingerprint string, score int",
    )


def bag(df) -> Counter:
    return Counter(tuple(r) for r in df.collect())
