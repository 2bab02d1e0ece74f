"""Cut a submission into its numbered answers.

Markers are found by regular expressions whose match positions come from ``text.match_starts``; all rules
then work on small arrays of markers inside the row. The whole chain is a projection: no shuffle, no UDF.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markwell import constants as K
from markwell.functions import text as T
from markwell.functions.text import bind, let
from markwell.operators.generate import settled
from markwell.operators.running import last_values

SP, WD = f"[{K.SPACE_CLASS}]", f"[{K.WORD_CLASS}]"
MARKER = "struct<pos:int,rank:int,number:int>"
MARKERS = f"array<{MARKER}>"
WINDOW = 100
SKIP = r"^[: \t\n\r\x{A0}\x{2000}-\x{200B}]*"


@dataclass(frozen=True)
class Marker:
    pattern: str
    numbering: str = "digits"
    # lower-case stems, one of which any match contains; a text without them is not searched
    stems: tuple[str, ...] = ()

    @property
    def regex(self) -> str:
        return self.pattern.replace(r"\s", SP).replace(r"\w", WD).replace(r"\b", f"(?!{WD})")


NOUN = "(?:задание|вопрос|задача)"
NOUNS = ("задани", "вопрос", "задач")
# Explicit marker forms in order of priority (case is ignored, ^ is a line start).
EXPLICIT = (
    Marker(NOUN + r"\s+(\d+)\.?", stems=NOUNS),
    Marker(NOUN + r"\s*№\s*(\d+)", stems=("№",)),
    Marker(r"№\s*(\d+)", stems=("№",)),
    Marker(r"^(\d+)[.)]\s*" + NOUN + r"\b", stems=NOUNS),
    Marker(r"^[AАBБCСDД]\s*[.):\-]\s*", "letter"),
    Marker(r"ответ\s+(?:на\s+)?(\d+)", stems=("ответ",)),
    Marker(r"(?:картинка\s*[-–—]\s*ответ\s*|(?:рисунок|изображение)\s*[-–—]\s*ответ\s+)(\d+)", stems=("ответ",)),
    Marker(
        r"(?:перв(?:ое|ая|ый|ую)|втор(?:ое|ая|ой|ую)|трет(?:ье|ья|ий|ью)|четв[её]рт(?:ое|ая|ый|ую))\s+" + NOUN + r"\s*:?",
        "ordinal",
        ("перв", "втор", "трет", "четв"),
    ),
    Marker(
        r"вопрос\s+(?:перв(?:ый|ая|ое|ую)|втор(?:ой|ая|ое|ую)|трет(?:ий|ья|ье|ью)|четв[её]рт(?:ый|ая|ое|ую))\s*:?",
        "second_word",
        ("перв", "втор", "трет", "четв"),
    ),
    Marker(r"(?<!\w)\w+(?:ое|ая|ый|ую)\s+" + NOUN + r"\s*:?", "ordinal", tuple(stem for stem, _ in K.ORDINAL_STEMS[:5])),
    Marker(r"(?:вопрос|задача)\s+\w+(?:ий|ая|ое|ую)\s*:?", "second_word", tuple(stem for stem, _ in K.ORDINAL_STEMS[:5])),
    Marker(r"^(\d+)\s+вопрос", stems=("вопрос",)),
    Marker(r"^\s*(\d+)\s*" + NOUN + r"\b", stems=NOUNS),
    Marker(r"^\s*(\d+)\s*:\s*"),
    Marker(r"^\s*(?:i{1,3}|iv)\s*[).:\-]\s*", "roman"),
    Marker(r"ответ\s+на\s+" + NOUN + r"\s+(\d+)\.?", stems=("ответ",)),
)
# Fixed value: bare numbers at a line start, used only when explicit markers are too few.
NUMERIC = Marker(r"^(\d+)(?:\.|\)|\s+\))")
EXPLICIT_FLAGS, NUMERIC_FLAGS = "(?iumd)", "(?md)"
LETTERS = (("AА", 1), ("BБ", 2), ("CС", 3), ("DД", 4))

# Anchors of the four interview tasks.
ANCHORS = {
    1: (r"\bтаблиц\w*\s+clients\b", r"\bclients\s*\(", r"\bзарегистрировавш\w*\b.*\bклиент\w*\b"),
    2: (r"\bтаблиц\w*\s+items\b", r"\bitems\s*\(", r"\bстоимост\w*\s+товар\w*\b", r"\bисторич\w*\s+хранен\w*\b.*\bцен\b"),
    3: (
        r"\bтребуется\s+проверить\s+запрос\b", r"\bучебн\w*\s+схем\w*\s+hr\b", r"\bselect\s+department_id\b",
        r"\bemployees\b.*\bdepartments\b.*\blocations\b",
    ),
    4: (
        r"\bв\s+некоторой\s+комнате\b", r"\bобъясните\b.*\bкарандаш\b", r"\bкарандаш\b", r"\bперепрыг\w*\b",
        r"\bпрыг\w*\b.*\bкарандаш\b", r"\bкарандаш\b.*\bстен\w*\b", r"\bстен\w*\b.*\bкарандаш\b",
        r"\bуронили\b.*\bкарандаш\b", r"\bкарандаш\b.*\bупал\w*\b",
    ),
}
# Lower-case stems, one of which any anchor of the task contains.
ANCHOR_STEMS = {
    1: ("clients", "зарегистрировавш"),
    2: ("items", "стоимост", "историч"),
    3: ("требуется", "учебн", "select", "employees"),
    4: ("некоторой", "карандаш", "перепрыг"),
}
# Topic words of the fourth task.
TOPIC_WORDS = (
    "карандаш", "стен", "стена", "стены", "стене", "стеной",
    "комнат", "комната", "комнате", "комнату", "комнатой",
    "перепрыг", "перепрыгнуть", "прыг", "прыгать", "прыжок",
    "прыгнуть", "перешаг", "перешагнуть",
    "pencil", "wall", "room", "jump", "jumping",
    "упал", "упали", "уронили", "уронил", "упало",
    "угол", "углу", "угла", "corner",
    "некоторой", "некоторой комнате",
    "объясните", "объяснить", "почему",
)
# Prompt passages to remove and schema text to protect.
PROMPT_QUESTION = "В некоторой комнате на пол уронили карандаш. Объясните почему вы не можете через него перепрыгнуть?"
PROMPT_INTROS = (
    r"Представьте\s*,?\s*что\s+вы\s+устроились\s+работать.*?Дата-инженером.*?",
    r"До\s+вас\s+в\s+этой\s+компании.*?уволился\.",
    r"Ваша\s+задача\s+провести\s+проверку.*?",
    r"Вы\s+обратили\s+внимание\s+на\s+таблицу.*?",
    r"Таблица\s+имеет\s+следующую\s+схему\s*:",
    r"Считаете\s+ли\s+вы\s+данный\s+набор.*?",
    r"Если\s+нет\s*,?\s*то\s+напишите.*?",
    r"Требуется\s+проверить\s+запрос\s+на\s+корректность.*?",
    r"Существует\s+учебная\s+схема\s+HR.*?",
    r"Необходимо\s+получить\s+все\s+отделы.*?",
    r"Для\s+решения\s+задачи\s+был\s+написан\s+следующий\s+запрос\s*:",
)
PROTECTED = {
    1: (r"clients\s*\([^)]*\)", r"client_id\s+\w+", r"client_name\s+\w+", r"client_surname\s+\w+"),
    2: (r"items\s*\([^)]*\)", r"item_id\s+\w+", r"item_name\s+\w+", r"item_cost\s+\w+"),
    3: (r"SELECT\s+.*?FROM", r"EMPLOYEE\s+E", r"DEPARTMENTS\s+D", r"LOCATIONS", r"DEPARTMENT_ID", r"MANAGER_ID"),
}
COPIED_MARKERS = ("Вопрос", "Задание", "Задача", "Ответ")


def _portable(pattern: str) -> str:
    """Word edges and classes that know Cyrillic."""
    out = pattern.replace(r"\s", SP)
    out = out.replace(r"\w*\b", WD + "*").replace(r"\w", WD)
    if out.startswith(r"\b"):
        out = f"(?<!{WD})" + out[2:]
    out = out.replace(r".*\b", f".*(?<!{WD})")
    return out.replace(r"\b", f"(?!{WD})")


def _number(hit: str, numbering: str) -> str:
    """SQL text for the task number a marker names, 0 if none."""
    if numbering == "digits":
        return rf"coalesce(try_cast(regexp_extract({hit}, r'(\d+)', 1) AS int), 0)"
    if numbering == "letter":
        cases = " ".join(f"WHEN upper(left({hit}, 1)) IN ('{x[0]}', '{x[1]}') THEN {n}" for x, n in LETTERS)
        return f"CASE {cases} ELSE 0 END"
    if numbering == "roman":
        cases = " ".join(f"WHEN '{numeral}' THEN {n}" for numeral, n in K.ROMAN_NUMERALS)
        return f"CASE upper(regexp_extract({hit}, r'(?i)([iv]+)', 1)) {cases} ELSE 0 END"
    word = f"lower(regexp_extract({hit}, r'{SP}({WD}+)', 1))" if numbering == "second_word" else f"lower({hit})"
    cases = " ".join(f"WHEN startswith(w, '{stem}') THEN {n}" for stem, n in K.ORDINAL_STEMS)
    return bind(word, "w", f"CASE {cases} ELSE 0 END")


def _has_stem(low: str, stems: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({low}, '{stem}')" for stem in stems) + ")"


def _found(text: str, marker: Marker, rank: int, flags: str) -> str:
    """SQL text: markers of one form with numbers 1..4, in text order; ``low`` is the lower-case text."""
    numbered = (
        f"transform({T.match_starts(text, flags + marker.regex)}, m ->"
        f" named_struct('pos', m.pos, 'rank', {rank}, 'number', {_number('m.hit', marker.numbering)}))"
    )
    found = f"filter({numbered}, m -> m.number BETWEEN 1 AND 4)"
    return f"if({_has_stem('low', marker.stems)}, {found}, CAST(array() AS {MARKERS}))" if marker.stems else found


def _first_per_number(markers: Column) -> Column:
    """``markers`` sorted by position; keep the first of each number."""
    return let(
        markers,
        lambda ms: F.sort_array(
            F.array_compact(F.array(*[F.get(F.filter(ms, _is_number(k)), F.lit(0)) for k in K.TASKS]))
        ),
    )


def _is_number(k: int):
    return lambda m: m["number"] == k


def _first_per_position(markers: Column) -> Column:
    """``markers`` sorted by (position, rank); keep the first of each position."""
    return let(
        markers, lambda ms: F.filter(ms, lambda m, i: (i == 0) | (F.get(ms, i - 1)["pos"] != m["pos"]))
    )


def explicit_markers(text: str) -> Column:
    return _first_per_number(_first_per_position(F.expr(explicit_sql(text))))


def explicit_sql(text: str) -> str:
    """SQL text: the markers of all explicit forms, sorted by position and priority."""
    found = ", ".join(_found(text, m, r, EXPLICIT_FLAGS) for r, m in enumerate(EXPLICIT))
    return bind(f"lower({text})", "low", f"sort_array(concat({found}))")


def numeric_sql(text: str) -> str:
    """SQL text: all bare numbers at line starts."""
    return _found(text, NUMERIC, len(EXPLICIT), NUMERIC_FLAGS)


def numeric_markers(text_col: str, explicit: Column, exclude_after_explicit: bool = True) -> Column:
    """Bare numbers at line starts that are no sub-items of an explicit answer and no list items."""
    text = F.col(text_col)
    candidates = F.expr(numeric_sql(text_col))
    pair = rf"(\d+)[.)]{SP}*\n{SP}*(\d+)[.)]"
    size = F.size(explicit)

    def inside(m):
        def covers(e, i):
            upper = F.get(explicit, i + 1)["pos"]
            return (i < size - 1) & (e["pos"] <= m["pos"]) & (m["pos"] < upper) & (m["number"] <= e["number"])

        return F.exists(F.filter(explicit, covers), lambda e: F.lit(True))

    def list_item(m):
        around = F.substring(text, F.greatest(m["pos"] - 200, F.lit(0)) + 1, F.least(m["pos"], F.lit(200)) + 100)
        previous = F.regexp_extract(around, pair, 1).try_cast("bigint")
        current = F.regexp_extract(around, pair, 2).try_cast("bigint")
        repeated = F.coalesce(current <= previous, F.lit(False))
        if not exclude_after_explicit:
            return (m["pos"] > 0) & repeated
        next_one = F.coalesce((current == previous + 1) & previous.between(1, 3), F.lit(False))
        first_three = (size == 3) & F.forall(explicit, lambda e: e["number"] <= 3)
        with_explicit = ~(first_three & (m["number"] == 4)) & (m["pos"] > 0) & (repeated | next_one)
        return F.when(size > 0, with_explicit).otherwise((m["pos"] > 0) & repeated)

    kept = F.filter(candidates, lambda m: ~inside(m) & ~list_item(m)) if exclude_after_explicit else F.filter(
        candidates, lambda m: ~list_item(m)
    )
    return _first_per_number(kept)


def merge_markers(explicit: Column, numeric: Column) -> Column:
    """Four explicit markers win; otherwise both kinds, explicit first at equal positions."""
    extra = F.filter(numeric, lambda n: ~F.exists(explicit, lambda e: e["pos"] == n["pos"]))
    return F.when(F.size(explicit) >= 4, F.slice(explicit, 1, 4)).otherwise(
        _first_per_number(F.sort_array(F.concat(explicit, extra)))
    )


def with_markers(df: DataFrame, text_col: str = "content") -> DataFrame:
    """Add ``explicit``, ``numeric`` and ``markers``; each is evaluated once per row."""
    found = df.withColumn("explicit", explicit_markers(text_col))
    numbered = found.withColumn(
        "numeric",
        F.when(F.size("explicit") >= 4, F.array().cast(MARKERS)).otherwise(numeric_markers(text_col, F.col("explicit"))),
    )
    return numbered.withColumn("markers", merge_markers(F.col("explicit"), F.col("numeric")))


def _marker_length(text: str, pos: str, number: str | None) -> str:
    """SQL text: length of the marker at ``pos``.

    The first form whose first match nearby has ``number`` decides (any form if ``number`` is None), if nothing but the
    marker itself and blanks stand in front of that match: a marker form inside the answer takes no text from it.
    """
    forms = (*EXPLICIT, NUMERIC)
    options = []
    for marker in forms:
        regex = rf"(?iumds)\A(.*?)({marker.regex})"
        fits = f"length(hit) > 0 AND {_number('hit', marker.numbering)} = {number}" if number else "length(hit) > 0"
        near_enough = "if(length(whole) - length(hit) <= own, length(whole), NULL)"
        options.append(
            bind(
                f"regexp_extract(near, r'{regex}', 2)", "hit",
                f"if({fits}, {bind(f'regexp_extract(near, r{chr(39)}{regex}{chr(39)}, 0)', 'whole', near_enough)}, NULL)",
            )
        )
    there = rf"(?iumds)\A(?:{'|'.join(m.regex for m in forms)}){SKIP[1:]}"
    own = bind(f"length(regexp_extract(near, r'{there}', 0))", "own", f"coalesce({', '.join(options)}, 0)")
    return bind(f"substr({text}, {pos} + 1, {WINDOW})", "near", own)


def slice_segments(text: str, markers: str) -> Column:
    """Array of (task_number, start, content) between the markers.

    An image line that is followed by a further marker ends the answer before the image.
    """
    return F.expr(slice_sql(text, markers))


def slice_sql(text: str, markers: str) -> str:
    """``slice_segments`` as SQL text."""
    image = rf"\[Изображение(?::|{SP})"
    chars = K.SPACE_CHARS
    follower = f"get({markers}, i + 1).pos"
    separates = (
        f"{follower} IS NOT NULL AND rlike(body, r'{image}') AND"
        rf" rlike(regexp_replace(body, r'(?s)\A.*?{image}', ''), r'(?iu)(?:задание|вопрос|№){SP}*\d+')"
    )
    cut = rf"btrim(if({separates}, regexp_extract(body, r'(?s)\A(.*?){image}', 1), body), '{chars}')"
    body = bind(
        f"substr({text}, begin + 1, greatest(coalesce({follower}, length({text})) - begin, 0))", "body", cut
    )
    skipped = f"after + length(regexp_extract(substr({text}, after + 1), r'{SKIP}', 0))"
    content = bind(f"m.pos + {_marker_length(text, 'm.pos', 'm.number')}", "after", bind(skipped, "begin", body))
    return f"transform({markers}, (m, i) -> named_struct('task_number', m.number, 'start', m.pos, 'content', {content}))"


def anchor_pattern(task: int) -> str:
    return "(?ium)" + "|".join(_portable(p) for p in ANCHORS[task])


def _first_anchor(text: Column, task: int) -> Column:
    """First position of any anchor of the task, -1 if there is none."""
    pattern = anchor_pattern(task)
    low = F.lower(text)
    possible = F.coalesce(*[F.when(low.contains(stem), True) for stem in ANCHOR_STEMS[task]], F.lit(False))
    return F.when(possible, F.regexp_instr(text, F.lit(pattern)) - 1).otherwise(-1)


def anchor_split(df: DataFrame, text_col: str = "content") -> DataFrame:
    """Add ``anchored``: array of (task_number, content) cut at topic anchors, order 1<2<3<4 enforced."""
    text = F.col(text_col)
    placed = df.withColumns({f"_a{k}": _first_anchor(text, k) for k in (2, 3, 4)})
    ordered = placed.withColumn(
        "_a2", F.when((F.col("_a2") >= 0) & (F.col("_a3") >= 0) & (F.col("_a2") > F.col("_a3")), -1).otherwise(F.col("_a2"))
    ).withColumn(
        "_a4",
        F.when(
            (F.col("_a4") >= 0) & (F.col("_a3") >= 0) & (F.col("_a4") < F.col("_a3")),
            let(
                _first_anchor(F.substring(text, F.col("_a3") + 1, F.length(text)), 4),
                lambda p: F.when(p >= 0, p + F.col("_a3")).otherwise(-1),
            ),
        ).otherwise(F.col("_a4")),
    )
    a2, a3, a4 = (F.col(f"_a{k}") for k in (2, 3, 4))

    def first_of(*positions):
        return F.coalesce(*[F.when(p >= 0, p) for p in positions])

    def cut(start: Column, end: Column | None):
        stop = F.length(text) if end is None else F.coalesce(end, F.length(text))
        return T.strip(F.substring(text, start + 1, F.greatest(stop - start, F.lit(0))))

    none = (a2 < 0) & (a3 < 0) & (a4 < 0)
    blank = F.lit("")
    parts = {
        1: F.when(none, blank).otherwise(cut(F.lit(0), first_of(a2, a3, a4))),
        2: F.when(a2 >= 0, cut(a2, first_of(a3, a4))).otherwise(blank),
        3: F.when(a3 >= 0, cut(a3, first_of(a4))).otherwise(blank),
        4: F.when(a4 >= 0, cut(a4, None)).otherwise(blank),
    }
    anchored = F.array(*[F.struct(F.lit(k).alias("task_number"), c.alias("content")) for k, c in parts.items()])
    return ordered.withColumn("anchored", anchored).drop("_a2", "_a3", "_a4")


def _content_of(segments: Column, task: int) -> Column:
    """First non-empty content of a task, '' if there is none."""
    hits = F.filter(segments, lambda s: (s["task_number"] == task) & (F.length(s["content"]) > 0))
    return F.coalesce(F.get(hits, F.lit(0))["content"], F.lit(""))


def missing_segment(text: str, markers: str, third: str) -> Column:
    """Text of an unmarked fourth answer behind the third one, '' if nothing convincing follows."""
    return F.expr(missing_sql(text, markers, third))


def missing_sql(text: str, markers: str, third: str) -> str:
    """``missing_segment`` as SQL text."""
    chars = K.SPACE_CHARS
    gap = rf"[.;]{SP}*\n{SP}*\n"
    suffix = f"btrim(right({third}, 100), '{chars}')"
    by_suffix = bind(suffix, "s", rf"if(length(s) > 0 AND rlike({third}, r'[.;]{SP}*$') AND instr(rest, s) > 0, instr(rest, s) - 1 + length(s), NULL)")
    offset = rf"if(rlike(rest, r'{gap}'), length(regexp_extract(rest, r'(?s)\A.*?{gap}', 0)), coalesce({by_suffix}, length({third})))"
    topics = " + ".join(f"CAST(contains(lower(t), '{w}') AS int)" for w in TOPIC_WORDS)
    tail = bind(f"btrim(substr(rest, {offset} + 1), '{chars}')", "t", f"if(length(t) >= 20 AND {topics} >= 2, t, '')")
    rest = rf"substr({text}, after + length(regexp_extract(substr({text}, after + 1), r'^[ \t\n\r]*', 0)) + 1)"
    found = bind(f"p + {_marker_length(text, 'p', None)}", "after", bind(rest, "rest", tail))
    position = f"get(filter({markers}, m -> m.number = 3), 0).pos"
    return bind(position, "p", f"if(p IS NOT NULL AND length({third}) > 0, {found}, '')")


def strip_prompt_text(text: Column, task: Column, prompted: tuple[int, ...] = ()) -> Column:
    """Remove passages copied from the task prompt; tasks without a known prompt stay as they are."""
    cleaned = {k: (_strip_question(text) if k == 4 else _strip_intros(text, k)) for k in prompted}
    out = text
    for k, value in cleaned.items():
        out = F.when((task == k) & ~T.is_blank(text), value).otherwise(out)
    return out


def _strip_question(text: Column) -> Column:
    return T.strip(F.regexp_replace(text, rf"(?iu)\Q{PROMPT_QUESTION}\E", ""))


def _strip_intros(text: Column, task: int) -> Column:
    guard = "(?ius)" + "|".join(_portable(p).replace(".*?", "[^\\n]*?") for p in PROTECTED[task])

    def drop(current, pattern):
        regex = "(?ius)" + _portable(pattern)

        def rebuild(hits):
            kept = F.transform(hits, lambda h: F.when(h.rlike(guard), h).otherwise(F.lit("")))
            parts = F.zip_with(F.split(current, regex), kept, lambda g, h: F.concat(g, F.coalesce(h, F.lit(""))))
            return F.when(F.size(hits) == 0, current).otherwise(F.array_join(parts, ""))

        return let(F.regexp_extract_all(current, F.lit(regex), F.lit(0)), rebuild)

    out = text
    for pattern in PROMPT_INTROS:
        out = _bind(out, drop, pattern)
    for word in COPIED_MARKERS:
        out = F.regexp_replace(out, rf"(?iumd)^{word}{SP}+\d+{SP}*\.?{SP}*", "")
    return T.strip(out)


def _bind(value: Column, step, pattern: str) -> Column:
    def body(current):
        return step(current, pattern)

    return let(value, body)


def assign_images(images: DataFrame, markers: DataFrame) -> DataFrame:
    """Task of each image: the last marker before its position; a boundary belongs to the earlier task.

    An as-of join: markers (doc_id, task_number, start) and images form one sorted table, and each image takes the last task in
    front of it. The first marker of a document also holds the image at its own position. An image without a position has no task.
    """
    first = F.min("start").over(Window.partitionBy("doc_id"))  # at most one marker per task
    marks = markers.groupBy("doc_id", "task_number").agg(F.min("start").alias("start")).select(
        "doc_id", F.col("start").cast("bigint").alias("_at"), F.when(F.col("start") == first, 0).otherwise(2).alias("_rank"),
        F.col("task_number").cast("bigint").alias("_no"), F.col("task_number").alias("_task"),
    )
    whole = images.withColumns(
        {"_at": F.col("position").cast("bigint"), "_rank": F.lit(1), "_no": F.monotonically_increasing_id(), "_task": F.lit(None).cast("int")}
    )
    merged = whole.withColumn("_image", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    seen = last_values(merged, ["doc_id"], ["_at", "_rank", "_no"], "_task", "_owner").filter("_image")
    return seen.select(*images.columns, F.when(F.col("_at").isNotNull(), F.col("_owner")).alias("task_number"))


def segment_documents(df: DataFrame, text_col: str = "content", prompted: tuple[int, ...] = ()) -> DataFrame:
    """Add ``answers``: exactly four (task_number, content), and ``markers`` for later use."""
    clean = df.withColumn("_text", T.strip_page_furniture(text_col))
    marked = with_markers(clean, "_text")
    sliced = marked.withColumn("_segments", slice_segments("_text", "markers"))
    anchored = anchor_split(sliced, "_text")
    count = lambda name: F.size(F.filter(name, lambda s: F.length(s["content"]) > 0))
    better = (count("anchored") > count("_segments")) & (count("anchored") >= 2)
    as_parts = F.transform(
        "_segments", lambda s: F.struct(s["task_number"].alias("task_number"), s["content"].alias("content"))
    )
    chosen = anchored.withColumn("_parts", F.when(better, F.col("anchored")).otherwise(as_parts))
    slots = chosen.withColumns({f"_t{k}": _content_of(F.col("_parts"), k) for k in K.TASKS})
    first_three = (F.col("_t4") == "") & (F.col("_t1") != "") & (F.col("_t2") != "") & (F.col("_t3") != "")
    completed = slots.withColumn(
        "_t4", F.when(first_three, missing_segment("_text", "markers", "_t3")).otherwise(F.col("_t4"))
    )
    answers = F.array(
        *[
            F.struct(
                F.lit(k).alias("task_number"), strip_prompt_text(F.col(f"_t{k}"), F.lit(k), prompted).alias("content")
            )
            for k in K.TASKS
        ]
    )
    return completed.withColumn("answers", answers).drop(
        "_text", "_segments", "_parts", "anchored", *[f"_t{k}" for k in K.TASKS]
    )


def segment_submissions(df: DataFrame, text_col: str = "content", prompted: tuple[int, ...] = ()) -> DataFrame:
    """(doc_id, task_number, content), four rows per document."""
    return segment_documents(df, text_col, prompted).select("doc_id", F.inline_outer("answers"))


def extraction_problems(segmented: DataFrame, text_col: str = "content") -> DataFrame:
    """One row per document with fewer than four non-empty answers.

    ``segmented`` carries ``answers`` and the text; markers are looked up again only for these documents.
    """
    filled = F.filter("answers", lambda a: ~T.is_blank(a["content"]))
    empty = F.transform(F.filter("answers", lambda a: T.is_blank(a["content"])), lambda a: a["task_number"])
    counted = segmented.select("doc_id", text_col, F.size(filled).alias("tasks_found"), empty.alias("empty_tasks"))
    short = settled(counted).filter("tasks_found < 4")
    text = T.strip_page_furniture(text_col)
    cols = ["doc_id", "tasks_found", "empty_tasks"]
    looked = short.select(*cols, text.alias("_text")).withColumn("explicit", explicit_markers("_text")).withColumn(
        "numeric", numeric_markers("_text", F.col("explicit"), exclude_after_explicit=False)
    )

    def label(m, width: int, kept: int):
        near = F.substring(F.col("_text"), m["pos"] + 1, F.lit(width))
        return F.left(T.strip(F.split(near, "\n", 2)[0]), F.lit(kept))

    named = F.transform(F.slice("explicit", 1, 4), lambda m: label(m, 50, 30))
    fresh = F.filter(
        F.slice("numeric", 1, 4), lambda n: ~F.exists("explicit", lambda e: e["number"] == n["number"])
    )
    detected = F.slice(F.concat(named, F.transform(fresh, lambda m: label(m, 20, 20))), 1, 4)
    return looked.select(
        "doc_id", "tasks_found", F.lit(4).alias("tasks_expected"), "empty_tasks",
        F.concat(F.lit("Найдено только "), "tasks_found", F.lit(" заданий из 4")).alias("problem_reason"),
        detected.alias("detected_markers"),
    )
