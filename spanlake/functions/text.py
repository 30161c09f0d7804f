"""Text scalar functions as Catalyst expressions (no UDFs).

Every function takes and returns a ``Column`` so that it runs inside whole-stage
codegen and works on batch and streaming DataFrames alike. The regular
expressions are written so that the same text is valid for Java (Spark) and RE2
(DuckDB, used as the test oracle); ``sql_*`` helpers render the DuckDB form.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's cleaning rules, in its order).
#   1. newline                      -> space
#   2. backslash followed by "n"    -> space
#   3. "#"                          -> space
#   4. “ ” ‘ ’                      -> '
#   5. 〈 < ＜ 「 ≪ 《 『            -> <
#   6. 〉 > ＞ 」 ≫ 》 』            -> >
#   7. whitespace run               -> one space
#   8. remove every character outside the keep class
# The keep class of the QA cleaner; the corpus cleaner is the same without ｜.
# Note that "-“ inside the class is a range (U+0022..U+201C); it is kept as is.
KEEP_QA = r"a-zA-Z0-9가-힣ㄱ-ㅎㅏ-ㅣぁ-ゔァ-ヴー々〆〤一-龥<>()\s\.\?!》《≪≫\'<>〈〉:‘’%,『』「」＜＞・\"-“”∧｜"
KEEP_CORPUS = KEEP_QA.replace("｜", "")
QUOTES = "“”‘’"
OPENERS = "〈<＜「≪《『"
CLOSERS = "〉>＞」≫》』"
# ---------------------------------------------------------------------------

# Python's Unicode whitespace (str.isspace). Java's \s is ASCII-only, so the
# class is spelled out to give the same result in Spark and in the oracle.
WS = (r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

# ASCII punctuation (Python's string.punctuation) as a class.
ASCII_PUNCT = r"[!-/:-@\[-`{-~]"

# Word tokens for retrieval, and the full-cover segmentation used for offsets:
# a run of letters/digits, or any single other character.
WORD = r"[\p{L}\p{N}]+"
SEGMENT = r"[\p{L}\p{N}]+|[^\p{L}\p{N}]"
# The same without most blanks, for tokenizers that drop them anyway.
SOLID_SEGMENT = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"

# Plain forms (used by the oracle SQL): the rules exactly as stated above.
CLEAN_STEPS_QA = (
    (r"\n", " "),
    (r"\\n", " "),
    ("#", " "),
    (f"[{QUOTES}]", "'"),
    (f"[{OPENERS}]", "<"),
    (f"[{CLOSERS}]", ">"),
    (f"{WS}+", " "),
    (f"[^{KEEP_QA}]", ""),
)
CLEAN_STEPS_CORPUS = CLEAN_STEPS_QA[:-1] + ((f"[^{KEEP_CORPUS}]", ""),)


def removed_class(keep: str) -> str:
    """The complement of a keep class as a *positive* class of ranges.

    Java evaluates a negated class several times slower than a positive one, so
    Spark gets the removed characters spelled as ranges. They are derived from
    the keep class itself by testing every BMP code point with Python's ``re``
    (whose ``\\s`` is Unicode, as in the original rule); surrogates and the
    supplementary planes are never kept. The oracle SQL keeps the plain negated
    form, so the oracle comparison checks this derivation too.
    """
    import re

    kept = re.compile(f"[{keep}]")
    ranges: list[list[int]] = []
    for c in range(0x10000):
        if 0xD800 <= c <= 0xDFFF or kept.match(chr(c)):
            continue
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    ranges += [[0xD800, 0xDFFF], [0x10000, 0x10FFFF]]
    body = "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)
    return f"[{body}]"


REMOVED_QA, REMOVED_CORPUS = removed_class(KEEP_QA), removed_class(KEEP_CORPUS)


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _cleaned(c: Column, removed: str) -> Column:
    """The steps in their order, single characters by one ``translate``. It follows the
    two-character escape, which none of its characters takes part in (a line break
    becomes a space, not a letter n)."""
    c = F.replace(c, F.lit("\\n"), F.lit(" "))
    c = F.translate(c, "\n#" + QUOTES + OPENERS + CLOSERS,
                    "  " + "'" * len(QUOTES) + "<" * len(OPENERS) + ">" * len(CLOSERS))
    return F.regexp_replace(F.regexp_replace(c, f"{WS}+", " "), removed, "")


def clean_qa(c) -> Column:
    """Normalise question/context/answer text (8 ordered replacements)."""
    return _cleaned(_col(c), REMOVED_QA)


def clean_corpus(c) -> Column:
    """Normalise corpus text; like T1 but the full-width bar is not kept."""
    return _cleaned(_col(c), REMOVED_CORPUS)


def title_prefix(title, text) -> Column:
    """T4: ``!!title!!text``, the passage form that is indexed."""
    return F.concat(F.lit("!!"), _col(title), F.lit("!!"), _col(text))


def sanitize_query(c) -> Column:
    """``~`` is an operator for the search syntax; replace it by ``-``."""
    return F.translate(_col(c), "~", "-")


def substr0(context, start, length) -> Column:
    """Substring with a 0-based start: Spark's ``substring`` is 1-based."""
    return F.substr(_col(context), _col(start) + F.lit(1), _col(length))


def span_text(context, start, end) -> Column:
    """``context[start:end]`` with 0-based, end-exclusive code-point offsets;
    negative lengths give ``''`` like Python slicing."""
    s, e = _col(start), _col(end)
    return substr0(context, s, F.greatest(e - s, F.lit(0)))


def squad_normalize(c) -> Column:
    """Lower, strip ASCII punctuation, drop the words a/an/the, collapse blanks."""
    x = F.regexp_replace(F.lower(_col(c)), F.lit(ASCII_PUNCT), F.lit(""))
    toks = F.split(x, WS + "+")
    kept = F.filter(toks, lambda t: (t != F.lit("")) & ~t.isin("a", "an", "the"))
    return F.array_join(kept, " ")


def squad_tokens(c) -> Column:
    """Token list of the normalised answer (empty array for an empty answer)."""
    n = squad_normalize(c)
    return F.filter(F.split(n, " "), lambda t: t != F.lit(""))


def words(c) -> Column:
    """Lower-cased word tokens used by the retrieval analyzer."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(WORD), 0)


def segments(c) -> Column:
    """Full-cover segmentation: concatenating the pieces gives the text back."""
    return F.regexp_extract_all(_col(c), F.lit(SEGMENT), 0)


# ----------------------------------------------------------------------------
# DuckDB renderings for the oracle SQL (same patterns, RE2 syntax).
def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_chain(expr: str, steps) -> str:
    for pattern, repl in steps:
        expr = f"regexp_replace({expr}, {sql_str(pattern)}, {sql_str(repl)}, 'g')"
    return expr


def sql_clean_qa(expr: str) -> str:
    return sql_chain(expr, CLEAN_STEPS_QA)


def sql_clean_corpus(expr: str) -> str:
    return sql_chain(expr, CLEAN_STEPS_CORPUS)


def sql_squad_normalize(expr: str) -> str:
    x = f"regexp_replace(lower({expr}), {sql_str(ASCII_PUNCT)}, '', 'g')"
    toks = f"regexp_split_to_array({x}, {sql_str(WS + '+')})"
    kept = f"list_filter({toks}, lambda t: t <> '' and t not in ('a', 'an', 'the'))"
    return f"array_to_string({kept}, ' ')"


def sql_words(expr: str) -> str:
    return f"regexp_extract_all(lower({expr}), {sql_str(WORD)})"
