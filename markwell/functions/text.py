"""Text projections as Catalyst expressions. Every function takes a column (or its name) and returns a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markwell import constants as K

Col = Column | str


def as_col(value: Col) -> Column:
    return F.col(value) if isinstance(value, str) else value


def let(value: Column, body) -> Column:
    """Bind ``value`` once for ``body``; branches would otherwise evaluate it again and again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(text: Col) -> Column:
    """Remove Unicode white space at both ends (``trim`` alone removes blanks only)."""
    return F.btrim(as_col(text), F.lit(K.SPACE_CHARS))


def is_blank(text: Col) -> Column:
    return F.coalesce(F.length(strip(text)) == 0, F.lit(True))


def squeeze_ws(text: Col) -> Column:
    return F.regexp_replace(as_col(text), f"[{K.SPACE_CLASS}]+", " ")


def normalize_ws_lower(text: Col) -> Column:
    return F.trim(squeeze_ws(F.lower(F.coalesce(as_col(text), F.lit("")))))


def normalize_strip_punct(text: Col) -> Column:
    """Lower case with every run of non-word characters turned into one blank."""
    lowered = F.lower(F.coalesce(as_col(text), F.lit("")))
    return F.trim(F.regexp_replace(lowered, f"[^{K.WORD_CLASS}]+", " "))


def word_count(text: Col) -> Column:
    return F.regexp_count(as_col(text), F.lit(f"[^{K.SPACE_CLASS}]+"))


def words(text: Col) -> Column:
    return F.regexp_extract_all(as_col(text), F.lit(f"[^{K.SPACE_CLASS}]+"), F.lit(0))


def strip_page_furniture(text: Col) -> Column:
    """Drop page captions, number-only lines, far-right page numbers and blank lines."""
    sp = f"[{K.SPACE_CLASS}]"
    lines = F.transform(
        F.split(as_col(text), "\n"), lambda ln: F.regexp_replace(ln, r"(?iu)(страница|page)\s+\d+", "")
    )
    lines = F.filter(lines, lambda ln: ~is_blank(ln) & ~ln.rlike(rf"^{sp}*\d+{sp}*$"))
    lines = F.transform(
        lines,
        lambda ln: F.when(
            ln.rlike(rf"^.{{0,10}}{sp}{{15,}}\d+{sp}*$"), F.regexp_replace(ln, rf"{sp}{{15,}}\d+{sp}*$", "")
        ).otherwise(ln),
    )
    return F.array_join(F.filter(lines, lambda ln: ~is_blank(ln)), "\n")


def split_sentences(text: Col) -> Column:
    parts = F.transform(F.split(as_col(text), rf"[.!?][{K.SPACE_CLASS}]+"), strip)
    return F.filter(parts, lambda p: F.length(p) > 0)


def split_paragraphs(text: Col, min_chars: int = K.TAIL_MIN_CHARS) -> Column:
    parts = F.transform(F.split(as_col(text), rf"\n[{K.SPACE_CLASS}]*\n"), strip)
    return F.filter(parts, lambda p: F.length(p) >= min_chars)


def tokenize(text: Col, stop_words: list[str] | None = None) -> Column:
    """White-space tokens longer than two characters that are no stop words."""
    stop = (K.RUSSIAN_STOP_WORDS + K.ENGLISH_STOP_WORDS) if stop_words is None else stop_words
    return F.filter(words(text), lambda w: (F.length(w) > 2) & ~w.isin(*[s for s in stop if len(s) > 2]))


def content_hash(data: Col) -> Column:
    return F.sha2(as_col(data), 256)


def short_hash(data: Col) -> Column:
    return F.substring(content_hash(data), 1, 5)


def file_extension(name: Col) -> Column:
    """Lower-case text after the last dot, '' if there is no dot."""
    return F.lower(F.regexp_extract(as_col(name), r"\.([^.]*)$", 1))


def file_stem(name: Col) -> Column:
    return F.regexp_replace(as_col(name), r"(?s)^(.+)\.[^.]*$", "$1")


def collapse_truncate(text: Col, limit: int | None = None) -> Column:
    flat = F.trim(squeeze_ws(F.coalesce(as_col(text), F.lit(""))))
    if limit is None:
        return flat
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("..."))).otherwise(flat)


def sanitize_for_prompt(text: Col) -> Column:
    t = strip(F.coalesce(as_col(text), F.lit("")))
    t = F.replace(t, F.lit("\r\n"), F.lit("\n"))
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n{4,}", "\n\n\n")
    cut = F.concat(F.left(t, F.lit(K.PROMPT_MAX_CHARS)), F.lit(K.PROMPT_CUT_NOTICE))
    return (
        F.when(is_blank(text), K.PROMPT_EMPTY).when(F.length(t) > K.PROMPT_MAX_CHARS, cut).otherwise(t)
    )


def tidy_generated(text: Col) -> Column:
    t = strip(F.regexp_replace(strip(as_col(text)), r"\n{3,}", "\n\n"))
    return F.when(is_blank(text), K.GENERATED_EMPTY).otherwise(t)


def format_percent(value: Col) -> Column:
    v = as_col(value).cast("double")
    return F.when(v.isNull() | F.isnan(v), "-").otherwise(F.format_string("%.1f%%", F.round(v * 100, 1)))


def gibberish(text: Col) -> Column:
    """True for text that looks like decoded binary."""
    t = as_col(text)
    s = strip(t)
    size = F.length(s)
    visible = F.regexp_count(s, F.lit(f"[^{K.SPACE_CLASS}]"))
    letters = F.regexp_count(s, F.lit(r"\p{L}"))
    return (
        F.when(t.isNull() | (F.length(t) == 0), True)
        .when(t.contains("Root Entry") & t.contains("WordDocument"), True)
        .when(size < 200, False)
        .when((size > 1500) & (letters < visible * 0.10), True)
        .otherwise(s.rlike(r"[#$%&\x27()*+,./0-9]{40,}"))
    )


def clean_lines(text: Col) -> Column:
    lines = F.transform(F.split(as_col(text), "\n"), strip)
    return F.array_join(F.filter(lines, lambda ln: F.length(ln) > 0), "\n")


def first_paragraph(text: Col, limit: int = 500) -> Column:
    t = strip(text)
    for prefix in K.GENERATED_PREFIXES:
        t = F.when(t.startswith(prefix), strip(F.substr(t, F.lit(len(prefix) + 1)))).otherwise(t)
    para = strip(F.split(t, "\n\n", 2)[0])
    cut = F.regexp_replace(F.left(para, F.lit(limit)), r"\.[^.]*$", "")
    return F.when(F.length(para) > limit, F.concat(cut, F.lit("."))).otherwise(para)


def extract_score(text: Col) -> Column:
    """First free-standing number between 0 and 100, else NULL."""
    pattern = rf"(?<![{K.WORD_CLASS}])\d+(?:\.\d+)?(?![{K.WORD_CLASS}])"
    numbers = F.transform(
        F.regexp_extract_all(as_col(text), F.lit(pattern), F.lit(0)), lambda n: n.try_cast("double")
    )
    return F.get(F.filter(numbers, lambda n: n.between(0, 100)), F.lit(0))


def extract_embedded_json(text: Col, schema: str) -> Column:
    """Parse the first ``{...}`` without an inner closing brace; NULL if absent or malformed."""
    block = F.regexp_extract(as_col(text), r"\{[^}]+\}", 0)
    return let(block, lambda b: F.when(F.try_parse_json(b).isNotNull(), F.from_json(b, schema)))


def append_image_text(text: Col, ocr_texts: Col) -> Column:
    found = F.filter(as_col(ocr_texts), lambda t: F.length(t) > 0)
    note = F.concat(
        as_col(text), F.lit("\n\n[Текст из изображений в ответе: "), F.array_join(found, "\n"), F.lit("]")
    )
    return F.when(F.size(found) > 0, note).otherwise(as_col(text))


def ordinal_number(word: Col) -> Column:
    lowered = F.lower(as_col(word))
    out = F.lit(0)
    for stem, number in reversed(K.ORDINAL_STEMS):
        out = F.when(lowered.startswith(stem), number).otherwise(out)
    return out


def roman_number(word: Col) -> Column:
    upper = F.upper(strip(F.coalesce(as_col(word), F.lit(""))))
    out = F.lit(0)
    for numeral, number in K.ROMAN_NUMERALS:
        out = F.when(upper == numeral, number).otherwise(out)
    return out


def sql_regex(pattern: str) -> str:
    """A pattern as a raw SQL literal."""
    if "'" in pattern:
        raise ValueError("write quotes in patterns as \\x27")
    return f"r'{pattern}'"


def bind(value: str, name: str, body: str) -> str:
    """SQL text that evaluates ``value`` once and uses it as ``name`` in ``body``."""
    return f"transform(array({value}), {name} -> {body})[0]"


def run_lengths(ordered: Column) -> Column:
    """Sorted array to (value, n) runs in n log n overall, without comparing all pairs."""
    def runs(s):
        starts = F.filter(
            F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1))
        )
        return let(
            starts,
            lambda p: F.transform(
                p,
                lambda at, j: F.struct(
                    F.get(s, at).alias("value"), (F.coalesce(F.get(p, j + 1), F.size(s)) - at).alias("n")
                ),
            ),
        )

    return let(ordered, lambda s: F.when(F.size(s) > 0, runs(s)))


def match_starts(text: str, pattern: str) -> str:
    """SQL text for all matches of ``pattern`` in ``text`` as an array of (pos, hit), counted from 0.

    ``split`` and ``regexp_extract_all`` walk the text the same way, so piece and match lengths
    give every offset without leaving the JVM.
    """
    regex = sql_regex(pattern)
    empty = "CAST(array() AS array<struct<pos:int,hit:string>>)"
    gaps = f"slice(transform(split({text}, {regex}), g -> length(g)), 1, size(hits))"
    pairs = f"zip_with({gaps}, hits, (g, h) -> named_struct('gap', g, 'hit', h))"
    step = (
        "(acc, p) -> named_struct('at', acc.at + p.gap + length(p.hit), 'found',"
        " concat(acc.found, array(named_struct('pos', acc.at + p.gap, 'hit', p.hit))))"
    )
    walk = f"aggregate({pairs}, named_struct('at', 0, 'found', {empty}), {step}, acc -> acc.found)"
    return bind(f"regexp_extract_all({text}, {regex}, 0)", "hits", f"if(size(hits) = 0, {empty}, {walk})")
