"""SQL functions and a table function for use in ``spark.sql``."""

from __future__ import annotations

from pyspark.sql import SparkSession

from markwell import constants as K
from markwell.functions.segment_sql import segment_query
from markwell.functions import style
from markwell.functions.charcounts import readability_function
from markwell.functions.text import bind

_DOT = "aggregate(zip_with(a, b, (x, y) -> x * y), CAST(0 AS double), (s, x) -> s + x)"
_NORM = "aggregate({0}, CAST(0 AS double), (s, x) -> s + x * x)"
SP, WD = K.SPACE_CLASS, K.WORD_CLASS


def _likelihood() -> str:
    def steps(count: str, *scores: float) -> str:
        return f"get(array({', '.join(f'CAST({x!r} AS double)' for x in scores)}), least({count}, {len(scores) - 1}))"

    def count(pattern: str) -> str:
        return f"regexp_count(txt, r'{pattern}')"

    bullets = f"least(10, {count('[•*]')} + {count(f'(?md)^[{SP}]*[-–][{SP}]+')})"
    phrases = " + ".join(f"CAST(contains(o.low, '{p}') AS int)" for p in K.FORMAL_PHRASES)
    patterns = " + ".join(
        f"CAST((o.folded OR contains(o.low, '{style.pattern_core(p)}')) AND rlike(txt, r'(?iu)" + p.replace(r"\s", f"[{SP}]") + "') AS int)"
        for p in K.FORMAL_PATTERNS
    )
    total = " + ".join(
        [
            steps(count(rf"\d+[.)][{SP}]+[А-Яа-яA-Z]"), *style.NUMBERED_SCORES),
            steps(bullets, *style.BULLET_SCORES),
            steps(f"({phrases})", *style.PHRASE_SCORES),
            steps(count(r"(?md)^[А-Яа-яA-Z][^.!?]{0,50}:"), *style.HEADER_SCORES),
            steps(f"({patterns})", *style.PATTERN_SCORES),
        ]
    )
    floor = "if(o.size >= 100 AND (contains(txt, '. ') OR contains(txt, chr(10))), CAST(0.05 AS double), CAST(0 AS double))"
    score = f"if(coalesce(o.size, 0) = 0, CAST(0 AS double), least(CAST(1 AS double), greatest({total}, {floor})))"
    once = f"named_struct('low', lower(txt), 'folded', rlike(txt, r'{style.FOLDED}'), 'size', length(btrim(txt, '{K.SPACE_CHARS}')))"
    return bind(once, "o", score)


FUNCTIONS = {
    "cosine": (
        "a array<double>, b array<double>", "double",
        f"coalesce(try_divide({_DOT}, sqrt({_NORM.format('a')} * {_NORM.format('b')})), CAST(0 AS double))",
    ),
    "l2_normalize": (
        "a array<double>", "array<double>",
        f"if({_NORM.format('a')} > 0, {bind(f'sqrt({_NORM.format(chr(97))})', 'n', 'transform(a, x -> x / n)')}, a)",
    ),
    "llm_likelihood": ("txt string", "double", _likelihood()),
    "keyword_hit": (
        "txt string, keyword string", "boolean",
        bind(
            f"trim(regexp_replace(lower(txt), r'[{SP}]+', ' '))", "t",
            f"if(rlike(lower(keyword), r'[^a-zа-я0-9_]'), contains(t, lower(keyword)),"
            f" rlike(t, concat(r'(?:^|[^{WD}])', lower(keyword), r'(?:$|[^{WD}])')))",
        ),
    ),
}


def register_functions(spark: SparkSession) -> list[str]:
    """Create the scalar functions and the table function ``segment_text`` for this session."""
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {result} RETURN {body}")
    answers = "TABLE(task_number INT, content STRING)"
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION segment_text(txt STRING) RETURNS {answers} RETURN {segment_query('segment_text.txt')}")
    spark.udf.register("readability", readability_function())
    return [*FUNCTIONS, "readability", "segment_text"]
