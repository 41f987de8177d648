"""Query language: what parses, what is refused, what the check says."""

import pytest

from lodestone.ql import checker
from lodestone.ql.parser import Join, SyntaxProblem, parse, tokenize

GOOD = [
    "ВЫБРАТЬ РАЗРЕШЕННЫЕ РАЗЛИЧНЫЕ А.Ссылка КАК С, СУММА(А.Вес) КАК Итог ПОМЕСТИТЬ Т1 ИЗ Документ.Груз КАК А ЛЕВОЕ СОЕДИНЕНИЕ Справочник.Место КАК М ПО А.М = М.Ссылка ГДЕ А.Дата МЕЖДУ &Н И &К И НЕ А.Снят "
    "СГРУППИРОВАТЬ ПО А.Ссылка ИМЕЮЩИЕ СУММА(А.Вес) > 0 УПОРЯДОЧИТЬ ПО Итог УБЫВ",
    "ВЫБРАТЬ ВЫБОР КОГДА А.Х ЕСТЬ НЕ NULL ТОГДА А.Х ИНАЧЕ 0 КОНЕЦ КАК Х, ВЫРАЗИТЬ(А.У КАК Число(10, 2)) КАК У, КОЛИЧЕСТВО(РАЗЛИЧНЫЕ А.З) ИЗ РегистрНакопления.Р КАК А ОБЪЕДИНИТЬ ВСЕ ВЫБРАТЬ 1, 2, 3",
    "ВЫБРАТЬ А.Х ИЗ Документ.Д.Строки КАК А ГДЕ (А.Х, А.У) В (ВЫБРАТЬ Б.Х, Б.У ИЗ Документ.Б КАК Б)",
    "ВЫБРАТЬ А.Х ПОМЕСТИТЬ В1 ИЗ Документ.Д КАК А; УНИЧТОЖИТЬ В1; ВЫБРАТЬ Б.Х ИЗ Б КАК Б ДЛЯ ИЗМЕНЕНИЯ",
    "ВЫБРАТЬ А.Х ИЗ Справочник.С КАК А ГДЕ А.Ссылка НЕ В ИЕРАРХИИ (&Г) УПОРЯДОЧИТЬ ПО А.Х ИЕРАРХИЯ УБЫВ АВТОУПОРЯДОЧИВАНИЕ",
    "ВЫБРАТЬ А.Х, СУММА(А.У) ИЗ Документ.Д КАК А СГРУППИРОВАТЬ ПО А.Х ИТОГИ ПО А.Х ТОЛЬКО ИЕРАРХИЯ КАК Х2",
    "ВЫБРАТЬ А.Х ИЗ Документ.Д КАК А ИТОГИ СУММА(А.Х) ПО ОБЩИЕ", "ВЫБРАТЬ А.Х ИЗ Документ.Д КАК А ИТОГИ ОБЩИЕ",
    "ВЫБРАТЬ А.Дата ИЗ Документ.Д КАК А ИТОГИ ПО А.Дата ПЕРИОДАМИ(ГОД, &Н, &К)",
    "ВЫБРАТЬ А.Х КАК Х {ГДЕ А.У = &П} ИЗ Документ.Д КАК А {ЛЕВОЕ СОЕДИНЕНИЕ Справочник.С КАК С ПО А.С = С.Ссылка}",
    "ВЫБРАТЬ А.Х ИЗ Документ.Д КАК А ГДЕ А.Х НЕ В (1, 2) И А.У НЕ МЕЖДУ 1 И 2 И А.З НЕ ПОДОБНО \"%x%\" И А.И ПОДОБНО \"a|_%\" СПЕЦСИМВОЛ \"|\"",
    "ВЫБРАТЬ А.Х ИЗ Документ.Д КАК А ДЛЯ ИЗМЕНЕНИЯ OF Документ.Д", "ВЫБРАТЬ А.* , ВЫБОР А.Х КОГДА 1 ТОГДА 'a''b' КОНЕЦ ИЗ &Таблица КАК А // конец",
    "ВЫБРАТЬ О.Х ИЗ РегистрНакопления.Р.Остатки(&Дата, {А, Б}, Х = 1) КАК О ГДЕ О.Х ССЫЛКА Справочник.С",
]
BAD = ["ВЫБРАТЬ А.Х ИЗ Документ.Д КАК А ГДЕ А.Х ЕСТЬ ИЕРАРХИЯ", "ВЫБРАТЬ А.Х % 2 ИЗ Документ.Д КАК А", "ВЫБРАТЬ А.Х ИЗ Документ.Д КАК А ГДЕ А.Х В &П", "ВЫБРАТЬ А.Х ИЗ", "", "ВЫБРАТЬ 'не закрыт", "ВЫБРАТЬ (1"]


@pytest.mark.parametrize("text", GOOD)
def test_parses(text):
    assert parse(text)


@pytest.mark.parametrize("text", BAD)
def test_refused(text):
    with pytest.raises(SyntaxProblem):
        parse(text)


def test_trees():
    flat = parse("ВЫБРАТЬ А.Х ИЗ Т КАК А СГРУППИРОВАТЬ ПО ГРУППИРУЮЩИМ НАБОРАМ (А.Х, А.У)")[0]
    nested = parse("ВЫБРАТЬ А.Х ИЗ Т КАК А СГРУППИРОВАТЬ ПО ГРУППИРУЮЩИМ НАБОРАМ ((А.Х), (А.Х, А.У))")[0]
    assert len(flat.flat_group) == 2 and len(nested.flat_group) == 3 and [len(s) for s in nested.grouping_sets] == [1, 2]
    q = parse("ВЫБРАТЬ А.Х Итог ИЗ Документ.Д А")[0]
    assert q.items[0].alias == "Итог" and q.source.alias == "А"
    j = parse("ВЫБРАТЬ 1 ИЗ А ЛЕВОЕ СОЕДИНЕНИЕ Б ЛЕВОЕ СОЕДИНЕНИЕ Г ПО Б.х = Г.х ПО А.х = Б.х")[0].source
    assert isinstance(j.right, Join) and j.right.right.parts == ["Г"]
    j = parse("ВЫБРАТЬ 1 ИЗ А ЛЕВОЕ СОЕДИНЕНИЕ Б ПО А.х = Б.х ЛЕВОЕ СОЕДИНЕНИЕ Г ПО Б.х = Г.х")[0].source
    assert isinstance(j.left, Join) and j.right.parts == ["Г"]
    assert [t.kind for t in tokenize("А.б <> 1.5 // x\n&П \"a\"\"b\"")][:6] == ["id", "op", "id", "op", "num", "param"]


@pytest.fixture(scope="module")
def context():
    objects = [("Catalog/Справочник1", "Catalog", "Справочник1"), ("Document/Заказ", "Document", "Заказ"), ("Enum/Виды", "Enum", "Виды"), ("Catalog/Пустой", "Catalog", "Пустой"), ("ExchangePlan/План", "ExchangePlan", "План")]
    attributes = [("Catalog/Справочник1", "СсылкаАтрибут", None), ("Document/Заказ", "НомерЗаказа", None), ("Document/Заказ", "Номенклатура", "Товары"), ("Document/Заказ", "Количество", "Товары"), ("Enum/Виды", "Х", None)]
    return checker.Context.from_rows(objects, attributes, names=[("Enum/Виды", "Приход"), ("Catalog/Справочник1", "ПредЗначение")], common=[("ОбщийТест", "Catalog/Справочник1"), ("Везде", None)],
                                     refs=[("Catalog/Справочник1", "СсылкаАтрибут", "Catalog/Справочник1"), ("Document/Заказ", "Номенклатура", "Catalog/Справочник1")])


@pytest.mark.parametrize(("text", "word"), [
    ("ВЫБРАТЬ Т.СсылкаАтрибут.СсылкаАтрибут ИЗ Справочник.Справочник1 КАК Т ГДЕ Т.СсылкаАтрибут.Наименование ПОДОБНО '%х%'", None),
    ("ВЫБРАТЬ СсылкаАтрибут ИЗ Справочник.Справочник1", None), ("ВЫБРАТЬ Нету ИЗ Справочник.Справочник1", "неизвестное поле"),
    ("ВЫБРАТЬ Т.Х ИЗ Справочник.Нет КАК Т", "неизвестная таблица"), ("ВЫБРАТЬ Т.Нет ИЗ Справочник.Справочник1 КАК Т", "неизвестное поле"),
    ("ВЫБРАТЬ Т.Приход ИЗ Перечисление.Виды КАК Т", None), ("ВЫБРАТЬ Т.ПредЗначение, Т.ОбщийТест, Т.Везде ИЗ Справочник.Справочник1 КАК Т", None), ("ВЫБРАТЬ Т.Приход ИЗ Справочник.Справочник1 КАК Т", "неизвестное поле"),
    ("ВЫБРАТЬ Т.Товары.Номенклатура.СсылкаАтрибут ИЗ Документ.Заказ КАК Т", None), ("ВЫБРАТЬ Т.Количество ИЗ Документ.Заказ.Товары КАК Т", None), ("ВЫБРАТЬ Т.Чужое ИЗ Документ.Заказ.Товары КАК Т", "неизвестное поле"),
    ("ВЫБРАТЬ Т.ЧтоУгодно ИЗ Справочник.Пустой КАК Т", None), ("ВЫБРАТЬ Т.Х ИЗ Справочник.Справочник1.СрезПоследних КАК Т", None), ("ВЫБРАТЬ Т.Код ИЗ ПланОбмена.План КАК Т", None),
    ("ВЫБРАТЬ Т.А КАК А ПОМЕСТИТЬ ВТ ИЗ Справочник.Пустой КАК Т; ВЫБРАТЬ Г.А ИЗ ВТ КАК Г", None), ("ВЫБРАТЬ Т.А КАК А ПОМЕСТИТЬ ВТ ИЗ Справочник.Пустой КАК Т; ВЫБРАТЬ Г.Б ИЗ ВТ КАК Г", "неизвестное поле"),
    ("ВЫБРАТЬ Т.Х ИЗ Справочник.Справочник1 КАК Т СГРУППИРОВАНО ПО Т.Х", "СГРУППИРОВАТЬ ПО"), ("ВЫБРАТЬ ВЫБОР Т.Нет КОГДА 1 ТОГДА 2 КОНЕЦ ИЗ Справочник.Справочник1 КАК Т", "неизвестное поле"),
])
def test_check(context, text, word):
    errors = checker.check(text, context).errors
    assert (errors == []) if word is None else any(word in e for e in errors), errors


def test_unverified(context):
    assert checker.check("ВЫБРАТЬ Т.Х ИЗ &Таблица КАК Т", context).unverified
