"""Fixed values that decide results: word lists, patterns, thresholds and message texts."""

from __future__ import annotations

TASKS = (1, 2, 3, 4)

# File types accepted for upload and the size limit in bytes.
ACCEPTED_TYPES = ("txt", "pdf", "docx", "md", "sql", "doc", "xlsx", "xls")
DECODABLE_TYPES = ("txt", "md", "sql", "pdf", "docx", "doc", "xlsx")
TEXT_TYPES = ("txt", "md", "sql")
MAX_UPLOAD_BYTES = 16 * 1024 * 1024

# Unicode white space, as a character set and as the inside of a regex class.
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0 "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "    　"
)
SPACE_CLASS = r"\s\x{0B}\x{1C}-\x{1F}\x{85}\p{Z}"
WORD_CLASS = r"\p{L}\p{N}_"

# Stop words (Russian, English).
RUSSIAN_STOP_WORDS = """
и в во не что он на я с со как а то все
она так его но да ты к у же вы за бы по
только ее мне было вот от меня еще нет о из
ему теперь когда даже ну вдруг ли если уже или
ни быть был него до вас нибудь опять уж вам ведь
там потом себя ничего ей может они тут где есть
надо ней для мы тебя их чем была сам чтоб без
будто чего раз тоже себе под будет ж тогда кто
этот того потому этого какой совсем ним здесь этом
один почти мой тем чтобы нее сейчас были куда зачем
всех никогда можно при наконец два об другой хоть
после над больше тот через эти нас про всего них
какая много разве три эту моя впрочем хорошо свою
этой перед иногда лучше чуть том нельзя такой им
более всегда конечно всю между
""".split()
ENGLISH_STOP_WORDS = """
the be to of and a in that have i it for
not on with he as you do at this but his by
from they we say her she or an will my one
all would there their what so up out if about
who get which go me when make can like time
no just him know take people into year your good
some could them see other than then now look only
come its over think also back after use two how
our work first well way even new want because any
these give day most us
""".split()

# Prompt hygiene.
PROMPT_MAX_CHARS = 12000
PROMPT_CUT_NOTICE = "\n...\n(отчёт обрезан по длине)"
PROMPT_EMPTY = "Отчёт пустой или не найден. Сформируй общий комментарий по результатам без деталей."
GENERATED_EMPTY = "Не удалось сформировать комментарий: недостаточно данных в отчёте."
GENERATED_PREFIXES = ("Комментарий:", "Оценка:", "Ответ:", "Комментарий преподавателя:")

# Words that make the first row of a text table a header.
TABLE_HEADER_WORDS = (
    "название", "тип", "поле", "текущий", "рекомендуемый", "обоснование",
    "name", "type", "field", "current", "recommended", "justification",
)

# Ordinal stems and roman numerals.
ORDINAL_STEMS = (
    ("перв", 1), ("втор", 2), ("трет", 3), ("четверт", 4), ("четвёрт", 4),
    ("пят", 5), ("шест", 6), ("седьм", 7), ("восьм", 8), ("девят", 9), ("десят", 10),
)
ROMAN_NUMERALS = (("I", 1), ("II", 2), ("III", 3), ("IV", 4))

# Writing-style heuristics.
EMOJI_CLASS = (
    r"\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
    r"\x{2702}-\x{27B0}\x{24C2}-\x{1F251}"
)
FORMAL_PHRASES = (
    "следует отметить", "необходимо отметить", "важно отметить",
    "стоит отметить", "можно отметить", "it should be noted",
    "it is important to", "it is necessary to", "в заключение",
    "подводя итог", "таким образом", "с одной стороны", "с другой стороны",
)
FORMAL_PATTERNS = (
    r"в\s+связи\s+с\s+тем", r"в\s+соответствии\s+с", r"с\s+учетом\s+того",
    r"во-первых", r"во-вторых", r"in accordance with", r"with regard to",
)
DEFAULT_STYLE_REFERENCE = (
    "Следует отметить, что в соответствии с указанными требованиями необходимо "
    "учитывать следующие аспекты: во-первых, структура данных должна соответствовать "
    "принципам нормализации; во-вторых, важно обеспечить целостность и согласованность."
)

# Thresholds of cleaning and comparison.
TAIL_SIMILARITY = 0.75
TAIL_MIN_CHARS = 20
SIMILAR_WORK_THRESHOLD = 0.70
TOP_SIMILAR = 3

# Answer grading.
COSINE_LO, COSINE_HI = 0.45, 0.90
WEIGHT_COSINE, WEIGHT_CRITERIA = 0.7, 0.3
LENGTH_MAX_PENALTY, LENGTH_MAX_BONUS, LENGTH_SMOOTHING = 1.5, 0.5, 30
UNCERTAINTY_PATTERNS = (
    r"\bне уверен\b", r"\bне уверена\b", r"\bне уверен(а)?\b",
    r"\bне знаю\b", r"\bне помню\b", r"\bзатрудняюсь\b",
    r"\bне эксперт\b", r"\bне специалист\b", r"\bмогу ошибаться\b",
    r"\bвозможно\b", r"\bскорее всего\b", r"\bпредположим\b",
)
CONCRETENESS_PATTERNS = {
    "keys": (r"\bprimary key\b", r"\bpk\b", r"\bforeign key\b", r"\bfk\b", r"\breference(s)?\b"),
    "constraints": (r"\bconstraint\b", r"\bnot null\b", r"\bcheck\b", r"\bunique\b", r"\bуникал\w*\b"),
    "indexes": (r"\bindex\b", r"\bиндекс\w*\b", r"\bbtree\b", r"\bhash\b"),
    "types": (
        r"\bint\b", r"\binteger\b", r"\bbigint\b", r"\bsmallint\b",
        r"\bdate\b", r"\btimestamp\b", r"\bdatetime\b", r"\bboolean\b",
        r"\btext\b", r"\bvarchar\b", r"\bchar\b", r"\bjsonb?\b",
        r"\bnumeric\b", r"\bdecimal\b", r"\bfloat\b", r"\bdouble\b",
    ),
    "normalization": (r"\bнормализац\w*\b", r"\b1нф\b", r"\b2нф\b", r"\b3нф\b", r"\bденормализац\w*\b"),
}
GRADE_BANDS = (
    (8.5, "Ответ полностью соответствует эталону: точная аргументация, корректные термины, логичная структура."),
    (6.0, "Ответ в целом соответствует эталону, но есть небольшие упущения или неточности в деталях."),
    (4.0, "Частичное соответствие: основные идеи верны, но много неточностей или пропущены ключевые моменты."),
)
GRADE_LOW = "Низкое соответствие: ответ содержит существенные ошибки, пропуски или нелогичные рассуждения."
GRADE_NONE = "Нет данных для оценки (нет эталона и/или ответа кандидата)."

# The criterion that is inverted by its name.
INVERTED_CRITERION = "отсутствие ошибок"

# Fallback comment and impression texts.
COMMENT_HIGH = "Ответ демонстрирует высокую схожесть с эталонным решением."
COMMENT_MEDIUM = "Ответ в целом соответствует эталону, но есть некоторые расхождения."
COMMENT_LOW = "Ответ имеет низкую схожесть с эталонным решением."
COMMENT_MACHINE = "Обнаружены признаки возможного использования автоматизированных инструментов."
COMMENT_ORIGINAL = "Текст выглядит оригинальным и написанным самостоятельно."
COMMENT_CLOSING = "Рекомендуется обратить внимание на детали и полноту ответа."
IMPRESSION_GREETING = "Уважаемый кандидат, спасибо за вашу работу!"
IMPRESSION_GREETING_START = "Уважаемый кандидат"
IMPRESSION_GOOD_SCORE = "Работа демонстрирует хорошее понимание материала"
IMPRESSION_GOOD_MATCH = "Ответы соответствуют эталонным решениям"
IMPRESSION_NEUTRAL = "Работа выполнена в установленные сроки."
IMPRESSION_WEAKNESS = "• Рекомендуется обратить внимание на детализацию ответов и полноту раскрытия темы."
IMPRESSION_CLOSING = "Желаем успехов в профессиональной деятельности!"
IMPRESSION_WINNER = "Наш менеджер в скором времени свяжется с вами!"

# Enumerations of the submission life cycle.
PROCESSING_STATES = ("pending", "processing", "completed", "error")
CANDIDATE_STATES = ("unread", "read", "recommended", "winner")
STAGES = (
    "upload", "parsing", "task_extraction", "cleaning", "embeddings", "similarity", "cheating_detection", "completed",
)
