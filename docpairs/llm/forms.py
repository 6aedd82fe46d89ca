"""Cutting texts into forms whose tokens do not depend on each other.

The byte-level pre-tokenisers never join what stands on both sides of the place before a
space, or a newline, that a non-space follows, nor a letter and the marks after it. A
text is cut there, so a worker needs the tokens of each distinct form once. Texts with
other white space are cut before a space and a non-space only.
"""

from __future__ import annotations

import re

_IRREGULAR = re.compile(r"[ \n](?=\s)|[ \n]\Z")
_BEFORE_WORD = re.compile(r"(?= \S)")
MARKS = ".,;:!?"


def text_forms(text: str) -> tuple[str, list[str], bool]:
    """``(head, forms, newline)``. A form that starts with a newline is meant as it
    stands, any other with a space before it. With ``newline`` the head is empty and the
    first form has a newline that the text has not."""
    if not text:
        return "", [], False
    if text[0].isspace() or _IRREGULAR.search(text):
        head, *words = _BEFORE_WORD.split(text)
        return head, [w[1:] for w in words], False
    return "", ("\n" + text).replace("\n", " \n").split(" ")[1:], True


def spelled(form: str) -> str:
    return form if form[:1] == "\n" else " " + form


def stem(form: str) -> str:
    """The form without the marks after its last letter (itself where there are none)."""
    cut = form.rstrip(MARKS)
    return cut if len(cut) < len(form) and cut[-1:].isalpha() else form
