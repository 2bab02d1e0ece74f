"""The segmentation of a text as one SQL query, for a table function without Python.

Steps are subqueries over one row, one below the other: clean text, markers of both kinds, their merger, the cut at markers and the
cut at topic anchors, the better of both, and a fourth answer without a marker. Marker forms, anchors and cuts come
from ``operators.segmentation``; this module only says in SQL how they go together.
"""

from __future__ import annotations

from markwell import constants as K
from markwell.functions.text import bind, sql_regex
from markwell.operators import segmentation as G

SP = f"[{K.SPACE_CLASS}]"
CHARS = f"'{K.SPACE_CHARS}'"


def _blank(text: str) -> str:
    return f"coalesce(length(btrim({text}, {CHARS})) = 0, true)"


def _clean(text: str) -> str:
    """Without page captions, number-only lines, far-right page numbers and blank lines."""
    lines = f"transform(split({text}, '\\n'), l -> regexp_replace(l, {sql_regex(r'(?iu)(страница|page)\s+\d+')}, ''))"
    lines = f"filter({lines}, l -> NOT {_blank('l')} AND NOT rlike(l, {sql_regex(rf'^{SP}*\d+{SP}*$')}))"
    far = sql_regex(rf"^.{{0,10}}{SP}{{15,}}\d+{SP}*$")
    lines = f"transform({lines}, l -> if(rlike(l, {far}), regexp_replace(l, {sql_regex(rf'{SP}{{15,}}\d+{SP}*$')}, ''), l))"
    return f"array_join(filter({lines}, l -> NOT {_blank('l')}), '\\n')"


def _first_per_number(markers: str) -> str:
    firsts = ", ".join(f"get(filter(ms, m -> m.number = {k}), 0)" for k in K.TASKS)
    return bind(markers, "ms", f"sort_array(array_compact(array({firsts})))")


def _first_per_position(markers: str) -> str:
    return bind(markers, "ps", "filter(ps, (m, i) -> i = 0 OR get(ps, i - 1).pos <> m.pos)")


def _kept_numbers() -> str:
    """Bare numbers that are no sub-items of an explicit answer and no list items."""
    inside = (
        "size(filter(explicit, (e, i) -> i < size(explicit) - 1 AND e.pos <= m.pos AND m.pos < get(explicit, i + 1).pos"
        " AND m.number <= e.number)) > 0"
    )
    pair = sql_regex(rf"(\d+)[.)]{SP}*\n{SP}*(\d+)[.)]")
    around = "substr(t, greatest(m.pos - 200, 0) + 1, least(m.pos, 200) + 100)"
    number = "try_cast(regexp_extract(around, {pair}, {k}) AS bigint)"
    both = f"named_struct('p', {number.format(pair=pair, k=1)}, 'c', {number.format(pair=pair, k=2)})"
    repeated = "coalesce(b.c <= b.p, false)"
    following = "coalesce(b.c = b.p + 1 AND b.p BETWEEN 1 AND 3, false)"
    fourth = "(size(explicit) = 3 AND forall(explicit, e -> e.number <= 3) AND m.number = 4)"
    with_explicit = f"(NOT {fourth} AND m.pos > 0 AND ({repeated} OR {following}))"
    item = bind(around, "around", bind(both, "b", f"if(size(explicit) > 0, {with_explicit}, m.pos > 0 AND {repeated})"))
    return f"filter({G.numeric_sql('t')}, m -> NOT ({inside}) AND NOT {item})"


def _merged() -> str:
    extra = "filter(bare, n -> NOT exists(explicit, e -> e.pos = n.pos))"
    return f"if(size(explicit) >= 4, slice(explicit, 1, 4), {_first_per_number(f'sort_array(concat(explicit, {extra}))')})"


def _anchor(text: str, task: int) -> str:
    stems = " OR ".join(f"contains(lower({text}), '{stem}')" for stem in G.ANCHOR_STEMS[task])
    return f"if({stems}, regexp_instr({text}, {sql_regex(G.anchor_pattern(task))}) - 1, -1)"


def _anchors() -> str:
    """Positions of the anchors of tasks 2 to 4, in order; -1 for none."""
    later = bind(_anchor("substr(t, p.a3 + 1)", 4), "q", "if(q >= 0, q + p.a3, -1)")
    second = "if(p.a2 >= 0 AND p.a3 >= 0 AND p.a2 > p.a3, -1, p.a2)"
    fourth = f"if(p.a4 >= 0 AND p.a3 >= 0 AND p.a4 < p.a3, {later}, p.a4)"
    found = f"named_struct('a2', {_anchor('t', 2)}, 'a3', {_anchor('t', 3)}, 'a4', {_anchor('t', 4)})"
    return bind(found, "p", f"named_struct('a2', {second}, 'a3', p.a3, 'a4', {fourth})")


def _anchored() -> str:
    def first_of(*names: str) -> str:
        return ", ".join(f"if(a.{n} >= 0, a.{n}, NULL)" for n in names)

    def cut(start: str, *ends: str) -> str:
        stop = f"coalesce({first_of(*ends)}, length(t))" if ends else "length(t)"
        return f"btrim(substr(t, {start} + 1, greatest({stop} - {start}, 0)), {CHARS})"

    parts = (
        f"if(a.a2 < 0 AND a.a3 < 0 AND a.a4 < 0, '', {cut('0', 'a2', 'a3', 'a4')})", f"if(a.a2 >= 0, {cut('a.a2', 'a3', 'a4')}, '')",
        f"if(a.a3 >= 0, {cut('a.a3', 'a4')}, '')", f"if(a.a4 >= 0, {cut('a.a4')}, '')",
    )
    rows = ", ".join(f"named_struct('task_number', {k}, 'content', {c})" for k, c in enumerate(parts, 1))
    return bind(_anchors(), "a", f"array({rows})")


def segment_query(text: str) -> str:
    """SELECT text with the four answers (task_number, content) of one text, a null text like an empty one."""
    def filled(name: str) -> str:
        return f"size(filter({name}, s -> length(s.content) > 0))"

    chosen = f"if({filled('anchored')} > {filled('segments')} AND {filled('anchored')} >= 2, anchored, segments)"
    contents = [
        f"coalesce(get(filter(parts, s -> s.task_number = {k} AND length(s.content) > 0), 0).content, '')" for k in K.TASKS
    ]
    segments = f"transform({G.slice_sql('t', 'markers')}, s -> named_struct('task_number', s.task_number, 'content', s.content))"
    fourth = f"if(c4 = '' AND c1 <> '' AND c2 <> '' AND c3 <> '', {G.missing_sql('t', 'markers', 'c3')}, c4)"
    steps = (
        (f"SELECT {_clean(f'coalesce({text}, {chr(39) * 2})')} AS t"),
        (f"SELECT t, {_first_per_number(_first_per_position(G.explicit_sql('t')))} AS explicit"),
        (f"SELECT t, explicit, if(size(explicit) >= 4, CAST(array() AS {G.MARKERS}), {_first_per_number(_kept_numbers())}) AS bare"),
        (f"SELECT t, {_merged()} AS markers"),
        (f"SELECT t, markers, {segments} AS segments, {_anchored()} AS anchored"),
        (f"SELECT t, markers, {chosen} AS parts"),
        ("SELECT t, markers, " + ", ".join(f"{c} AS c{k}" for k, c in enumerate(contents, 1))),
        (f"SELECT c1, c2, c3, {fourth} AS c4"),
    )
    query = ""
    for step in steps:
        query = f"{step} FROM ({query})" if query else step
    rows = ", ".join(f"named_struct('task_number', {k}, 'content', c{k})" for k in K.TASKS)
    return f"SELECT inline(array({rows})) FROM ({query})"
