"""Text column functions (FN-7..11, FIL-1 tokenisation, TXT-6).

Every function is a native Spark expression (whole-stage codegen, no Python).
Regular expressions are written in the common subset of Java regex and RE2 so
the DuckDB oracles can use the same patterns.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Separators and patterns.
WORD_BREAK = r"[^\p{L}\p{N}]+"              # keyword matching: non letters/digits
TOKEN_PATTERN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]"  # "regex" token counter
PARAGRAPH_SEP = "\n\n"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def word_tokens(text) -> Column:
    """Lower-cased letter/digit runs; the split may leave empty strings at the
    ends, which never match a term."""
    return F.split(F.lower(F.regexp_replace(_c(text), WORD_BREAK, " ")), " ")


def ws_token_count(text) -> Column:
    """FN-7: ``len(s.split(" "))`` — single-space split, empties kept."""
    return F.size(F.split(_c(text), " ", -1))


def regex_token_count(text) -> Column:
    """FN-8 ``regex`` mode: letter runs, digit runs, single other non-space chars."""
    return F.regexp_count(_c(text), F.lit(TOKEN_PATTERN))


def token_count(text, mode="regex") -> Column:
    """FN-7 / FN-8 / UDF-4: tokens of a text.  ``mode`` is ``ws``, ``regex`` or the caller's counter, a function of a
    column that gives an integer column (built-in expressions or a pandas UDF around a tokenizer); it gets null texts
    as empty ones."""
    if callable(mode):
        return mode(F.coalesce(_c(text), F.lit(""))).cast("int")
    if mode == "ws":
        return ws_token_count(text)
    if mode == "regex":
        return regex_token_count(text)
    raise ValueError("token mode must be 'ws', 'regex' or a function of a column")


def truncate_words(text, max_tokens: int = 4096) -> Column:
    """FN-9: keep the first ``max_tokens`` single-space-separated words."""
    return F.array_join(F.slice(F.split(_c(text), " ", -1), 1, max_tokens), " ")


_PLACEHOLDER = re.compile(r"\{(\w+)\}")


def fill_template(template: str, **values) -> Column:
    """FN-10: replace ``{name}`` placeholders by columns.

    Every placeholder of the template must be given and every given name must
    occur in the template; otherwise the error is raised while the plan is
    built, not at run time.
    """
    names = set(_PLACEHOLDER.findall(template))
    missing, extra = names - set(values), set(values) - names
    if missing or extra:
        raise ValueError(f"template placeholders {sorted(names)}; missing {sorted(missing)}, "
                         f"unknown {sorted(extra)}")
    parts: list[Column] = []
    pos = 0
    for m in _PLACEHOLDER.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(_c(values[m.group(1)]))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts) if parts else F.lit("")


def template_overhead(template: str, mode="regex") -> int:
    """Tokens of the template without its placeholders (prompt overhead), by the same counter as the texts."""
    bare = _PLACEHOLDER.sub(" ", template)
    if callable(mode):
        return int(SparkSession.active().range(1).select(token_count(F.lit(bare), mode)).first()[0])
    if mode == "ws":
        return len(bare.split(" ")) - len(_PLACEHOLDER.findall(template))
    import regex as _re  # the third-party module understands \p{L}
    return len(_re.findall(TOKEN_PATTERN, bare))


def with_instruction(text, instruction, model_type, instruct_type: str = "instruct") -> Column:
    """FN-11 / EMB-3: prefix the instruction only for instruct-type models."""
    return F.when(_c(model_type) == F.lit(instruct_type),
                  F.concat(F.coalesce(_c(instruction), F.lit("")), _c(text))).otherwise(_c(text))


def chunk_id(key, idx) -> Column:
    """FN-6: ``{key}_split-{idx}``."""
    return F.concat(_c(key).cast("string"), F.lit("_split-"), _c(idx).cast("string"))
