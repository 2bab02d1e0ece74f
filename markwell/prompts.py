"""Prompt texts for an external model. Only the texts are built here; no model is called."""

from __future__ import annotations

# Prompt templates; names in braces are replaced by columns.
GRADING = """Ты - опытный преподаватель, оценивающий ответ студента на задание {task_number}.

Задание {task_number}:
{text}

Метрики оценки:
- Схожесть с эталонным ответом: {similarity_ref}
{others}{metrics}
Напиши краткий комментарий (1 абзац, 3-5 предложений) на русском языке, который:
1. Отмечает хорошие стороны решения
2. Указывает на недостатки или ошибки
3. Дает общую оценку качества ответа

Комментарий должен быть конструктивным и полезным для студента. Начни сразу с комментария, без предисловий:"""
GRADING_OTHERS = "- Схожесть с другими ответами: {max_similarity}\n"
GRADING_METRICS = "- Вероятность использования LLM: {likelihood}\n- Читаемость текста: {readability}\n"
LOGIC = """Оцени логичность следующего ответа студента по шкале от 0 до 100%.

Ответ студента:
{text}

Оцени:
- Логическую последовательность мыслей
- Связность аргументов
- Структурированность изложения
- Соответствие логике рассуждения

Верни только число от 0 до 100 (процент логичности), без дополнительных комментариев:"""
ORIGINALITY = """Оцени оригинальность следующего ответа студента по шкале от 0 до 100%.

Ответ студента:
{text}

Максимальная схожесть с другими ответами: {max_similarity}

Оцени:
- Уникальность формулировок
- Оригинальность подхода
- Неповторимость изложения
- Творческий подход

Верни только число от 0 до 100 (процент оригинальности), без дополнительных комментариев:"""
TAILS = """Проанализируй задание {task_number} и определи, содержит ли оно фрагменты текста, относящиеся к другим заданиям.

Задание {task_number}:
{text}

Другие задания:
{others}

Определи, есть ли в задании {task_number} фрагменты, которые относятся к другим заданиям (1-4). Если да, выдели эти фрагменты и укажи к какому заданию они относятся.

Ответ в формате JSON:
{
    "has_tails": true/false,
    "tails": [
        {"text": "фрагмент текста", "belongs_to_task": 2},
        ...
    ]
}"""
IMPRESSION_HEAD = "Ты - опытный преподаватель, оценивающий общую работу кандидата.\n\n"
IMPRESSION_TAIL = """
Напиши общее впечатление от работы кандидата на русском языке в следующем формате:
1. Начни с: "Уважаемый кандидат, спасибо за вашу работу!"
2. Опиши 2-3 хорошие черты работы (1 абзац)
3. Укажи 1 ключевой недостаток, над которым нужно поработать (в виде пункта)
4. Заверши: "Желаем успехов в профессиональной деятельности!" """
IMPRESSION_WINNER = (
    'или "Желаем успехов в профессиональной деятельности! Наш менеджер в скором времени свяжется с вами!"'
)
IMPRESSION_FORMAT = """

Формат: 1 абзац + пункты. Текст должен быть вежливым и конструктивным. Начни сразу с приветствия:"""
HR_SUMMARY = """Ты — помощник HR. Твоя задача: по входному отчёту (ниже) написать короткое резюме для HR.

Требования:
- Пиши по-русски, деловой тон.
- Объем: 700-10000 символов.
- Сфокусируйся на: сильные стороны, слабые стороны/риски, что стоит перепроверить, итоговая оценка (если есть).
- Если в отчёте есть признаки расхождений/ошибок расчётов или предупреждения — упомяни их и что проверить.
- Не используй внутренние термины про модель/эмбеддинги/формулы. Только наблюдения из отчёта.
- Не добавляй фактов, которых нет в отчёте.
- Вывод без заголовков типа "Резюме:" — сразу текст. Можно использовать короткие маркированные строки.
- Не перечисляй все вопросы подряд; выдели самое важное.

ОТЧЁТ:
{report}
"""
CANDIDATE_SUMMARY = """Ты — помощник, который формирует фидбек кандидату по результатам проверки.

Требования:
- Пиши по-русски, дружелюбно-нейтральный тон.
- Объем: 700-10000 символов.
- Объясни: что было учтено в оценке (в терминах критериев/ожиданий), что чаще всего не хватило,
  и 3-5 конкретных направлений как улучшить ответы в следующий раз (без "внутренней кухни").
- Укажи итоговую оценку работы, если она есть.
- Не упоминай внутренние механики и не говори про эталоны/модели/формулы.
- Не добавляй фактов, которых нет в отчёте.
- Вывод без заголовков типа "Фидбек:" — сразу текст.

ОТЧЁТ:
{report}
"""
