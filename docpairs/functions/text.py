"""Column functions for cleaning, validity and tokenisation (all Catalyst, no UDF).

Each function takes and returns a ``Column`` so it composes inside ``select`` /
``withColumn`` and stays in the JVM. Regular expressions are Java patterns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values (must equal the reference for equal results) -------------------
# Python's whitespace set (str.isspace) on U+0001..U+2FFF plus U+3000, written as a
# Java character class body. Java's \s and (?U)\s both differ from it.
WS_CHARS = r"\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# The same set without the line feed (per-line right strip).
WS_CHARS_NO_NL = r"\x09\x0b-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Section headers that end the summary part of a docstring (case-insensitive).
SECTION_WORDS = "Args|Parameters|Returns|Raises|Yields|Examples?|Notes?"
# Lower-cased docstring prefixes that mark boilerplate (no word boundary).
BOILERPLATE_PREFIXES = ("todo", "fixme", "auto-generated", "getter for", "setter for")
# Python keywords kept whole by the code tokenizer (case-sensitive).
PYTHON_KEYWORDS = (
    "False", "None", "True", "and", "as", "assert", "async", "await",
    "break", "class", "continue", "def", "del", "elif", "else", "except",
    "finally", "for", "from", "global", "if", "import", "in", "is",
    "lambda", "nonlocal", "not", "or", "pass", "raise", "return", "try",
    "while", "with", "yield",
)
# Special tokens with their fixed ids 0..3.
PAD, SOS, EOS, UNK = "<PAD>", "<SOS>", "<EOS>", "<UNK>"
SPECIAL_TOKENS = (PAD, SOS, EOS, UNK)
PAD_IDX, SOS_IDX, EOS_IDX, UNK_IDX = 0, 1, 2, 3
# Validity bounds: docstring words in [3, 128], code words >= 3.
MIN_WORDS, MAX_DOC_WORDS = 3, 128
# Truncation caps of the sequence datasets.
MAX_SRC_LEN, MAX_TGT_LEN = 256, 128
# ---------------------------------------------------------------------------------

# The same sets, spelled so that a plain character is told by one or two comparisons: Java
# tests the parts of a class one after the other.
_WS_FAR = r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]"
WS = rf"[\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x85\xa0{_WS_FAR}]"
WS_NO_SPACE = rf"[\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x85\xa0{_WS_FAR}]"
WS_NO_NL = rf"[\x09\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x85\xa0{_WS_FAR}]"
NOT_WS = f"[!-~[^{WS_CHARS}]]"
# Whitespace runs other than one space: most are one space, and a match costs far more than
# a look.
WS_RUN = rf"(?:{WS_NO_SPACE}{WS}*+|\x20{WS}++)"
WS_LIST = "".join(map(chr, [*range(0x09, 0x0e), *range(0x1c, 0x21), 0x85, 0xa0, 0x1680, *range(0x2000, 0x200b),
                            0x2028, 0x2029, 0x202f, 0x205f, 0x3000]))
WORD_CHAR = r"a-zA-Z0-9_\p{L}\p{N}"
MARK_RE = rf"([^{WORD_CHAR}{WS_CHARS}])"
# Tokens that splitting leaves as they are: lower-case words, numbers, ASCII marks.
PLAIN_TOKEN_RE = r"\A(?:[a-z]+|[0-9]+|[!-/:-@\[-\^`{-~])\z"
CAMEL_PIECE_RE = r"[a-z]+|[A-Z][a-z]*|[0-9]+"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove whitespace at both ends."""
    return F.btrim(_col(c), F.lit(WS_LIST))


def _pieces(spaced: Column) -> Column:
    """The non-empty pieces between spaces (one character: split without a regex)."""
    return F.array_remove(F.split(spaced, " "), "")


def _words(c: Column) -> Column:
    """The pieces between whitespace runs."""
    return _pieces(F.regexp_replace(c, WS_NO_SPACE, " "))


def clean_docstring(c) -> Column:
    """Strip, strip quote runs, cut at the first section header, collapse
    whitespace, delete URLs (after collapsing, so two spaces may remain), strip."""
    t = strip_ws(F.coalesce(_col(c), F.lit("")))
    t = F.btrim(F.btrim(t, F.lit('"')), F.lit("'"))
    t = F.regexp_replace(t, rf"(?isu)\n{WS}*(?:{SECTION_WORDS}):.*", "")
    t = F.trim(F.regexp_replace(t, WS_RUN, " "))
    t = F.regexp_replace(t, rf"https?://{NOT_WS}+", "")
    return F.trim(t)


def clean_code(c) -> Column:
    """Tabs to four spaces, 3+ newlines to two, right-strip each line, strip."""
    t = F.coalesce(_col(c), F.lit(""))
    t = F.replace(t, F.lit("\t"), F.lit("    "))
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    t = F.regexp_replace(t, rf"{WS_NO_NL}++(?=\n|\z)", "")
    return strip_ws(t)


def word_count(c) -> Column:
    """Number of Python ``str.split()`` words (pieces between whitespace runs)."""
    return F.size(_words(_col(c)))


def has_words(c, n: int) -> Column:
    """Whether ``c`` has at least ``n`` words; the text is read no further than that."""
    return (F.length(_col(c)) >= 2 * n - 1) & _col(c).rlike(rf"\A(?:{WS}*+{NOT_WS}++){{{n}}}")


def reject_reason(code, doc, doc_words=None, code_words=None) -> Column:
    """First failing validity rule (null when the pair is valid).

    Inputs are the *cleaned* code and docstring. ``doc_words``/``code_words`` may
    name precomputed word counts; without them the words are counted up to the bounds."""
    code, doc = _col(code), _col(doc)
    short = ~has_words(doc, MIN_WORDS) if doc_words is None else _col(doc_words) < MIN_WORDS
    long = has_words(doc, MAX_DOC_WORDS + 1) if doc_words is None else _col(doc_words) > MAX_DOC_WORDS
    code_short = ~has_words(code, MIN_WORDS) if code_words is None else _col(code_words) < MIN_WORDS
    prefix = "^(?:" + "|".join(BOILERPLATE_PREFIXES) + ")"
    return (F.when((code == "") | (doc == ""), F.lit("empty"))
            .when(short, F.lit("doc_too_short"))
            .when(long, F.lit("doc_too_long"))
            .when(code_short, F.lit("code_too_short"))
            .when(F.lower(strip_ws(doc)).rlike(prefix), F.lit("boilerplate")))


def is_valid_pair(code, doc, doc_words=None, code_words=None) -> Column:
    """A pair is valid when no rule rejects it."""
    return reject_reason(code, doc, doc_words, code_words).isNull()


def split_identifier(t) -> Column:
    """snake_case → lower-cased non-empty parts (all underscores → unchanged);
    otherwise camel pieces lower-cased, or the lower-cased token."""
    t = _col(t)
    parts = F.filter(F.split(t, "_"), lambda p: p != "")
    pieces = F.regexp_extract_all(t, F.lit(CAMEL_PIECE_RE), 0)
    snake = F.when(F.size(parts) > 0, F.transform(parts, F.lower)).otherwise(F.array(t))
    camel = F.when(F.size(pieces) > 0, F.transform(pieces, F.lower)).otherwise(F.array(F.lower(t)))
    return F.when(F.instr(t, "_") > 0, snake).otherwise(camel)


def raw_code_tokens(c) -> Column:
    """Word runs and single non-word, non-space characters, in order."""
    # Marks are set apart by spaces, which no token holds: ``regexp_extract_all`` copies the
    # whole text for every match.
    return _words(F.regexp_replace(F.coalesce(_col(c), F.lit("")), MARK_RE, " $1 "))


def tokenize_code(c, split_identifiers: bool = True) -> Column:
    """Code tokens; keywords kept, other tokens split by T2."""
    raw = raw_code_tokens(c)
    if not split_identifiers:
        return raw
    kw = F.array(*[F.lit(k) for k in PYTHON_KEYWORDS])
    return F.flatten(F.transform(
        raw, lambda t: F.when(t.rlike(PLAIN_TOKEN_RE) | F.array_contains(kw, t), F.array(t)).otherwise(split_identifier(t))))


def tokenize_text(c) -> Column:
    """Lower-case, split on whitespace, drop empty strings."""
    return _words(F.lower(F.coalesce(_col(c), F.lit(""))))


def whitespace_tokens(c) -> Column:
    """T5: whitespace split keeping case (metric tokens)."""
    return _words(F.coalesce(_col(c), F.lit("")))


def rouge_tokens(c) -> Column:
    """T6 (unstemmed): lower-case, non-[a-z0-9] runs to a space, split, drop empties."""
    return _pieces(F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), "[^a-z0-9]+", " "))


def strip_specials(tokens) -> Column:
    """Drop the four special tokens, keep duplicates of the others."""
    sp = F.array(*[F.lit(s) for s in SPECIAL_TOKENS])
    return F.filter(_col(tokens), lambda t: ~F.array_contains(sp, t))


def join_tokens(tokens, sep: str = " ") -> Column:
    """Join tokens with one space."""
    return F.array_join(_col(tokens), sep)


def exact_match(ref, pred) -> Column:
    """Equal after strip + lower-case."""
    return F.lower(strip_ws(_col(ref))) == F.lower(strip_ws(_col(pred)))
