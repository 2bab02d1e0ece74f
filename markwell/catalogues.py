"""Ready-made criteria catalogues for ``operators.criteria``; any other mapping of the same form works."""

from __future__ import annotations

from markwell.operators.criteria import Catalogue, Criterion

# Interview criteria per question (name, keywords). The last one is inverted by its name.
INTERVIEW: Catalogue = {
    1: (
        Criterion("Дополнительные поля", (
            "добавить поле", "новое поле", "расширить", "date_of_birth", "дата рождения", "email", "телефон",
            "is_active", "контактная информация", "номер телефона", "мессенджеры", "статус аккаунта",
            "язык интерфейса", "флаги настроек", "статус", "активен", "active", "удален", "deleted",
            "время регистрации", "timestamp", "default", "phone", "birth_date", "gdpr_consent", "updated_at",
            "deleted_at",
        )),
        Criterion("Первичный/внешний ключи", (
            "первичный ключ", "primary key", "внешний ключ", "foreign key", "уникальность", "unique", "client_id",
            "city_id", "not null", "обязательный", "constraint", "ограничение", "ссылочная целостность",
            "доменная целостность",
        )),
        Criterion("Типы данных", (
            "тип данных", "int", "bigint", "number", "заменить", "client_id", "вычислять через дату рождения",
            "birth_date", "возраст", "дата рождения", "хранить", "изменить", "рекомендовать",
        )),
        Criterion("Нормализация", (
            "нормализация", "вынести", "отдельная таблица", "справочник", "боковая таблица", "зависимая таблица",
            "метаданные", "время сессии", "дата последнего подключения", "3nf", "третья нормальная форма",
            "избыточно", "целостность", "индекс", "check",
        )),
        Criterion("Историчность", ("историчность", "история", "дата изменения", "версия", "valid_from", "valid_to")),
    ),
    2: (
        Criterion("Понимание проблемы отчетности", (
            "не построить отчетность", "не хватает истории", "цена меняется", "историческое хранение", "переработать",
            "дополнить боковыми таблицами", " отдельную таблицу", "создание отдельной таблицы",
            "финансовой отчетности", "нужна переработка", "изменение цен", "динамика цен", "акции", "скидки",
            "сезонные", "повышение", "понижение", "отчетность", "финансовая отчетность", "аналитика",
            "теряется история", "только текущая цена", "не сохраняет", "нельзя отследить",
            "непригодна для аналитики",
        )),
        Criterion("Доработка под историчность", (
            "историчность", "таблица цен", "price_history", "scd", "медленно меняющиеся", "история изменений", "scd2",
            "даты актуальности", "историчность цен", "привести к scd2", "scd4", "item_prices", "cost_history",
            "valid_from", "valid_to", "start_date", "end_date", "date_from", "date_to", "период действия",
            "актуальна", "текущая цена",
        )),
        Criterion("Нормализация и 3НФ", (
            "нормализация", "3нф", "3НФ", "третья нормальная форма", "отдельная таблица",
            "звездно-снежинковая схема", "декомпозиция", "справочник категорий", "отдельная таблица поставщиков",
            "вынести item_name", "item_desc", "item_vendor", "поставщик", "vendor", "категория", "category", "валюта",
            "currency", "декомпозировать", "item_name", "item_desc", "item_vendor",
        )),
        Criterion("Внешние/первичные ключи", (
            "внешний ключ", "foreign key", "первичный ключ", "primary key", "ссылка", "id валюты", "id поставщика",
            "ссылка на валюту",
        )),
        Criterion("Агрегаты для отчетности", (
            "агрегаты", "материализованное представление", "витрина", "отдельные объекты", "средневзвешенная",
            "агрегация", "вычислять как средневзвешенную",
        )),
    ),
    3: (
        Criterion("Алиасы атрибутов", ("алиас", "псевдоним", "ambiguous", "отсутствие алиасов")),
        Criterion("Избыточные атрибуты", (
            "избыточные атрибуты", "не требуется id", "лишние поля", "не требуется выводить ID отдела и сумму зарплат",
        )),
        Criterion("Явный JOIN", (
            "явный join", "join", "inner join", "вместо неявного", "неявный джоин", "устаревший синтаксис",
        )),
        Criterion("Название таблицы EMPLOYEE", (
            "employee", "employees", "неправильное название", "таблица EMPLOYEE указана неверно",
        )),
        Criterion("Сравнение с NULL", ("is null", "manager_id is null", "= null ошибка")),
        Criterion("Подзапрос и IN", (
            "in", "подзапрос вернет много", "дедубликация", "подзапрос вернет более одного значения",
            "вернет несколько значений",
        )),
        Criterion("Регистр города", (
            "регистр", "upper", "lower", "like", "принудительно привести к верхнему регистру", "использовать like",
        )),
        Criterion("HAVING", ("having", "агрегация в where", "агрегатная функция", "sum")),
        Criterion('Условие "более"', ("более", ">=", "строго больше")),
        Criterion("GROUP BY", (
            "group by", "department_name", "departments.id", "атрибутивный состав в группировке не соответствует",
            "не все поля", "отсутствует",
        )),
    ),
    4: (
        Criterion("Скрытое условие", (
            "стена", "к стене", "угол", "в угол", "другая комната", "в другой комнате", "вплотную", "препятствие",
            "мебель", "положили вплотную", "рядом со стеной", "под шкаф", "под стол", "под комод", "закатился",
            "укатился", "не в той комнате", "доступа нет", "закрыта",
        )),
        Criterion("Конкретная причина", (
            "нет места", "не разбежаться", "не приземлиться", "блокирует", "проходить сквозь", "вплотную к стене",
            "стена мешает", "не могу прыгать", "низкий потолок", "нет смысла", "незачем", "перешагнуть",
        )),
        Criterion("Логическая обоснованность", (
            "потому что", "так как", "следовательно", "поэтому", "в таком случае", "из-за того что", "тогда",
        )),
        Criterion("Отсутствие ошибок", ("нельзя вообще", "физически невозможно")),
    ),
}
