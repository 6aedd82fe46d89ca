"""DuckDB (RE2) spellings of the column functions, used only to write oracle SQL.

Each helper takes a SQL expression and returns a SQL expression. RE2 has no
lookahead and no class intersection, and wants ``\\x{...}`` escapes, so the
patterns are spelled differently from the Java ones in ``functions.text`` while
meaning the same thing.
"""

from __future__ import annotations

from ..functions.stem import IRREGULAR, STEP2, STEP3, STEP4
from ..functions.text import (BOILERPLATE_PREFIXES, MAX_DOC_WORDS, MIN_WORDS,
                              PYTHON_KEYWORDS, SECTION_WORDS, SPECIAL_TOKENS)

WS_CHARS = (r"\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
            r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WS_CHARS_NO_NL = (r"\x{09}\x{0b}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
                  r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
WS = f"[{WS_CHARS}]"
NOT_WS = f"[^{WS_CHARS}]"
DQUOTE_RUNS = r'\A"+|"+\z'
SQUOTE_RUNS = r"\A'+|'+\z"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip_ws(x: str) -> str:
    return f"regexp_replace({x}, {q(rf'\A{WS}+|{WS}+\z')}, '', 'g')"


def clean_docstring(x: str) -> str:
    t = strip_ws(f"coalesce({x}, '')")
    t = f"regexp_replace({t}, {q(DQUOTE_RUNS)}, '', 'g')"
    t = f"regexp_replace({t}, {q(SQUOTE_RUNS)}, '', 'g')"
    t = f"regexp_replace({t}, {q(rf'(?is)\n{WS}*(?:{SECTION_WORDS}):.*')}, '')"
    t = f"trim(regexp_replace({t}, {q(WS + '+')}, ' ', 'g'))"
    t = f"regexp_replace({t}, {q(rf'https?://{NOT_WS}+')}, '', 'g')"
    return f"trim({t})"


def clean_code(x: str) -> str:
    t = f"replace(coalesce({x}, ''), chr(9), '    ')"
    t = f"regexp_replace({t}, {q(r'\n{3,}')}, chr(10) || chr(10), 'g')"
    t = f"regexp_replace({t}, {q(rf'[{WS_CHARS_NO_NL}]+(\n|$)')}, {q(chr(92) + '1')}, 'g')"
    return strip_ws(t)


def word_count(x: str) -> str:
    return f"CAST(len(regexp_extract_all({x}, {q(NOT_WS + '+')})) AS BIGINT)"


def reject_reason(code: str, doc: str) -> str:
    prefix = "^(?:" + "|".join(BOILERPLATE_PREFIXES) + ")"
    return (f"CASE WHEN {code} = '' OR {doc} = '' THEN 'empty' "
            f"WHEN {word_count(doc)} < {MIN_WORDS} THEN 'doc_too_short' "
            f"WHEN {word_count(doc)} > {MAX_DOC_WORDS} THEN 'doc_too_long' "
            f"WHEN {word_count(code)} < {MIN_WORDS} THEN 'code_too_short' "
            f"WHEN regexp_matches(lower({strip_ws(doc)}), {q(prefix)}) THEN 'boilerplate' END")


def split_identifier(t: str) -> str:
    parts = f"list_filter(string_split({t}, '_'), lambda p: p <> '')"
    pieces = f"regexp_extract_all({t}, '[a-z]+|[A-Z][a-z]*|[0-9]+')"
    return (f"CASE WHEN contains({t}, '_') THEN "
            f"(CASE WHEN len({parts}) > 0 THEN list_transform({parts}, lambda p: lower(p)) ELSE [{t}] END) "
            f"ELSE (CASE WHEN len({pieces}) > 0 THEN list_transform({pieces}, lambda p: lower(p)) "
            f"ELSE [lower({t})] END) END")


def raw_code_tokens(x: str) -> str:
    pat = rf"[\pL\pN_]+|[^\pL\pN_{WS_CHARS}]"
    return f"regexp_extract_all(coalesce({x}, ''), {q(pat)})"


def tokenize_code(x: str, split_identifiers: bool = True) -> str:
    raw = raw_code_tokens(x)
    if not split_identifiers:
        return raw
    kw = "[" + ", ".join(q(k) for k in PYTHON_KEYWORDS) + "]"
    return (f"flatten(list_transform({raw}, lambda tk: CASE WHEN list_contains({kw}, tk) "
            f"THEN [tk] ELSE {split_identifier('tk')} END))")


def tokenize_text(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({x}, '')), {q(WS + '+')}), lambda w: w <> '')"


def whitespace_tokens(x: str) -> str:
    return f"list_filter(regexp_split_to_array(coalesce({x}, ''), {q(WS + '+')}), lambda w: w <> '')"


def rouge_tokens(x: str) -> str:
    t = f"regexp_replace(lower(coalesce({x}, '')), '[^a-z0-9]+', ' ', 'g')"
    return f"list_filter(string_split({t}, ' '), lambda w: w <> '')"


def strip_specials(x: str) -> str:
    sp = "[" + ", ".join(q(s) for s in SPECIAL_TOKENS) + "]"
    return f"list_filter({x}, lambda w: NOT list_contains({sp}, w))"


def exact_match(ref: str, pred: str) -> str:
    return f"(lower({strip_ws(ref)}) = lower({strip_ws(pred)}))"


def join_tokens(x: str, sep: str = " ") -> str:
    return f"array_to_string({x}, {q(sep)})"


# ------------------------------------------------------------------ stems
# A second spelling of ``functions/stem.py``: a chain of CTEs over distinct tokens. The
# shape of a word is a string of C and V; y is settled from left to right.
def _shape(x: str) -> str:
    t = f"regexp_replace({x}, '[aeiou]', 'V', 'g')"
    for _ in range(4):
        t = f"regexp_replace(regexp_replace({t}, '(^|V)y', '\\1C', 'g'), '([^Vy])y', '\\1V', 'g')"
    return f"regexp_replace({t}, '[^V]', 'C', 'g')"


def _measure(x: str) -> str:
    return f"len(regexp_extract_all({_shape(x)}, 'VC'))"


def _ends(x: str, *suffixes: str) -> str:
    return "(" + " OR ".join(f"ends_with({x}, '{s}')" for s in suffixes) + ")"


def _short(x: str) -> str:
    return (f"((ends_with({_shape(x)}, 'CVC') AND right({x}, 1) NOT IN ('w', 'x', 'y')) OR {_shape(x)} = 'VC')")


def _rules(rules, least: int) -> str:
    arms = []
    for suffix, new in rules:
        stem = f"left(w, -{len(suffix)})"
        measured = "left(w, -3)" if suffix == "logi" else stem
        arms.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {_measure(measured)} > {least} THEN {stem} || '{new}' ELSE w END")
    return f"CASE {' '.join(arms)} ELSE w END"


def _step4() -> str:
    arms = []
    for suffix in STEP4:
        stem = f"left(w, -{len(suffix)})"
        extra = f" AND right({stem}, 1) IN ('s', 't')" if suffix == "ion" else ""
        arms.append(f"WHEN ends_with(w, '{suffix}') THEN CASE WHEN {_measure(stem)} > 1{extra} THEN {stem} ELSE w END")
    return f"CASE {' '.join(arms)} ELSE w END"


def stem_ctes(name: str, tokens_sql: str) -> tuple:
    """CTEs ending in ``name`` (token, stem) for the tokens of ``tokens_sql``."""
    e_stem = "left(w, -1)"
    steps = [
        f"CASE WHEN ends_with(w, 'ies') THEN left(w, CASE WHEN length(w) = 4 THEN -1 ELSE -2 END) "
        f"WHEN ends_with(w, 'sses') THEN left(w, -2) WHEN ends_with(w, 's') AND NOT ends_with(w, 'ss') THEN left(w, -1) ELSE w END",
        None,
        f"CASE WHEN ends_with(w, 'y') AND length(w) > 2 AND right({_shape(e_stem)}, 1) = 'C' THEN left(w, -1) || 'i' ELSE w END",
        f"CASE WHEN ends_with(w, 'alli') AND {_measure('left(w, -4)')} > 0 THEN left(w, -2) ELSE w END",
        _rules(STEP2, 0), _rules(STEP3, 0), _step4(),
        f"CASE WHEN ends_with(w, 'e') AND ({_measure(e_stem)} > 1 OR ({_measure(e_stem)} = 1 AND NOT {_short(e_stem)})) THEN {e_stem} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {_measure(e_stem)} > 1 THEN {e_stem} ELSE w END",
    ]
    out = [f"{name}_0 AS (SELECT DISTINCT token, token AS w FROM ({tokens_sql}) t WHERE token IS NOT NULL)"]
    for k, step in enumerate(steps):
        if step is not None:
            out.append(f"{name}_{k + 1} AS (SELECT token, {step} AS w FROM {name}_{k})")
            continue
        out.append(f"{name}_cut AS (SELECT token, w, CASE WHEN {_ends('w', 'ied', 'eed')} THEN NULL "
                   f"WHEN ends_with(w, 'ed') AND contains({_shape('left(w, -2)')}, 'V') THEN left(w, -2) "
                   f"WHEN ends_with(w, 'ing') AND contains({_shape('left(w, -3)')}, 'V') THEN left(w, -3) END AS st FROM {name}_{k})")
        out.append(f"{name}_{k + 1} AS (SELECT token, CASE "
                   "WHEN ends_with(w, 'ied') THEN left(w, CASE WHEN length(w) = 4 THEN -1 ELSE -2 END) "
                   f"WHEN ends_with(w, 'eed') THEN CASE WHEN {_measure('left(w, -3)')} > 0 THEN left(w, -1) ELSE w END "
                   f"WHEN st IS NULL THEN w WHEN {_ends('st', 'at', 'bl', 'iz')} THEN st || 'e' "
                   f"WHEN length(st) >= 2 AND right(st, 1) = right(left(st, -1), 1) AND right({_shape('st')}, 1) = 'C' "
                   "THEN CASE WHEN right(st, 1) IN ('l', 's', 'z') THEN st ELSE left(st, -1) END "
                   f"WHEN {_measure('st')} = 1 AND {_short('st')} THEN st || 'e' ELSE st END AS w FROM {name}_cut)")
    pool = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in IRREGULAR.items())
    out.append(f"{name} AS (SELECT token, CASE WHEN length(token) <= 3 THEN token ELSE CASE token {pool} ELSE w END END AS stem "
               f"FROM {name}_{len(steps)})")
    return tuple(out)
