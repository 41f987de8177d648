"""Code analysis on small module texts."""

from lodestone.functions import code as C

MODULE = """#Область Тест
Перем Кэш;

// Описание
//  вторая
&НаСервере
Процедура Первая(Отказ,
\t\tДругое = "а,б") Экспорт

\tКэш = Неопределено; // Модуль.Нет()
\tЕсли Отказ Тогда
\t\tОбщий.Метод("Общий.Литерал()");
\tКонецЕсли;
#Если Сервер Тогда
\tВычислить("Метод");
#КонецЕсли
КонецПроцедуры

Функция Вторая()
\tВозврат Первая(1, 2);
КонецФункции
"""


def test_split():
    rest, methods = C.split_module(MODULE)
    assert [(m.kind, m.name, m.is_export, m.directives, m.line_start, m.line_end) for m in methods] == [("процедура", "Первая", True, "&НаСервере", 7, 17), ("функция", "Вторая", False, "", 19, 21)]
    assert methods[0].signature == 'Отказ, Другое = "а,б"' and methods[0].description == "// Описание\n//  вторая"
    assert methods[0].body.startswith("Процедура Первая") and methods[0].body.endswith("КонецПроцедуры")
    assert "Кэш = Неопределено" not in rest and "Процедура Первая(Отказ,\n\t\tДругое" in rest and "Перем Кэш;" in rest
    assert C.split_module("") == ("", []) and C.split_module("Функция Х(А, Б = 1)")[1][0].signature == "А, Б = 1"


def test_masks_and_literals():
    text = 'А = "раз"; // "нет"\nБ = "два""три";\nВ = "много\n|строк";\nГ = "не закрыт\nД = 1;'
    assert [v for _, _, v in C.literals(text)] == ["раз", 'два"три', "много\nстрок"]
    m = C.masked(text)
    assert len(m) == len(text) and m.count("\n") == text.count("\n") and "раз" not in m and "нет" not in m


def test_calls():
    sites = C.call_sites(MODULE, "метод")
    assert [(c.line, c.form, c.left) for c in sites] == [(12, "dotted", "Общий"), (15, "string", None)]
    assert sites[0].conditions == ("блок Если (строка 11)",) and sites[1].conditions == ("#Если Сервер Тогда (строка 14)",)
    assert [(c.line, c.form) for c in C.call_sites(MODULE, "Первая")] == [(20, "plain")]
    assert C.call_sites(MODULE, "Литерал") == [] and C.call_sites(MODULE, "Нет") == []
    assert C.metadata_uses('Х = Справочники.Номенклатура.Создать(); // Документы.Нет') == [(1, "Catalog", "Номенклатура")]
    assert {"отказ", "другое", "кэш"} <= C.local_names(MODULE)
    assert C.parameters('Знач А, Б = "x,y", В = Ф(1, 2), Значение') == [("А", None, True), ("Б", '"x,y"', False), ("В", "Ф(1, 2)", False), ("Значение", None, False)]


def test_queries():
    text = 'З = "ВЫБРАТЬ Т.Х КАК Икс, Т.У" + // x\n"ИЗ Справочник.С КАК Т";\nН = "ВЫБРАТЬ Т.Х ИЗ " + Имя;\nО = "текст";\nТ.Колонки.Добавить("Кол");Т.Колонки.Добавить(Имя); С = Новый Структура("А, Б", 1, 2);'
    assert [(line, complete) for line, _, complete in C.embedded_queries(text)] == [(1, True), (3, False)]
    assert C.result_schema(text) == [("column", "Кол", 5), ("column from variable", "Имя", 5), ("key", "А", 5), ("key", "Б", 5), ("query column", "Икс", 1), ("query column", "У", 1)]


def test_compare():
    method = lambda text: C.split_module(text)[1][0]
    a = method('Процедура П(А, Б = 1)\n\tХ = "a  b"; // c\n\n\tУ = 2;\nКонецПроцедуры')
    assert C.compare_methods(a, a)["identical"]
    spaces = C.compare_methods(a, method('Процедура П(А, Б = 1)\n\tХ="a  b";\n\tУ =  2;\nКонецПроцедуры'))
    assert spaces["formatting_only"] and not spaces["body_changed"]
    literal = C.compare_methods(a, method('Процедура П(А, Б = 1)\n\tХ = "a b"; // c\n\n\tУ = 2;\nКонецПроцедуры'))
    assert literal["body_changed"] and any(line.startswith("+") for line in literal["diff"])
    other = C.compare_methods(a, method('Процедура П(Б = 2, В) Экспорт\n\tХ = "a  b"; // c\n\n\tУ = 2;\nКонецПроцедуры'))
    assert (other["params_added"], other["params_removed"], other["defaults_changed"], other["export_changed"], other["body_changed"]) == (["В"], ["А"], ["б"], True, False) or other["params_added"] == ["в"]
    assert C.normal_lines('А = 1; // x\n\n"б в" ;') == ["А=1;", None, '"б в";']
    assert C.intercepts('&НаСервере, &Вместо("Метод"), &После( "М2" )') == [("Вместо", "Метод"), ("После", "М2")]
    assert C.Lines.of("a\nbc\n")(3) == (1, 1)
