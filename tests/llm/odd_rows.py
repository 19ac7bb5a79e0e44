import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")

#: Rows every operator must take: null ids, null, empty and blank texts, repeats, and a very long text.
ODD = [
    (1, "The cat sat on the mat"),
    (1, "The cat sat on the mat"),
    (2, "the CAT sat on the mat"),
    (3, None),
    (4, ""),
    (5, " \t\n\x0b\f\r"),
    (None, "no id here"),
    (None, None, None, None),
    (6, "Éa É日本 \U0001f600 \x85 ñ", "fr", None),
    (7, "word " * 30_000, "en", "t"),
    (8, "#*$%&|<>\n\na\na\nb", "de", ""),
]
