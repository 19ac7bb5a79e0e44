"""Splitting text into pre-tokens by the pattern of byte-level BPE vocabularies.

The pattern is: contractions, a run of letters, of digits or of other signs,
each with one space before it or none, and runs of white space that leave
their last character to what follows. Texts in Latin-1 are split by ``re``
with the classes spelt out; for any other text the tokenizer library's own
splitter says where its Unicode tables put the cuts.
"""

from __future__ import annotations

import re

# The letters, numbers and white space of Latin-1.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBER = "0-9²³¹¼-¾"
SPACE = "\\t\\n\\x0b\\x0c\\r \u0085 "

#: Letters come first as most matches are words; only a match at an apostrophe can be a contraction.
_LATIN = re.compile(f" ?[{LETTER}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{NUMBER}]+| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall

_split = None


def pretokens(text: str) -> list[str]:
    """The pre-tokens of a text; joined they give the text."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return _library_pretokens(text)
    return _LATIN(text)


def _library_pretokens(text: str) -> list[str]:
    global _split
    if _split is None:
        from tokenizers.pre_tokenizers import ByteLevel

        _split = ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    out, end = [], 0
    for _, (_, stop) in _split(text):
        if stop > end:
            out.append(text[end:stop])
            end = stop
    return out
