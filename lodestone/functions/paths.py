"""Paths and names: slash paths, dotted Russian names, type texts, small value decoders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Type stems and their Russian names.
RUSSIAN = {
    "Catalog": "Справочник", "Document": "Документ", "Enum": "Перечисление", "InformationRegister": "РегистрСведений", "AccumulationRegister": "РегистрНакопления",
    "AccountingRegister": "РегистрБухгалтерии", "CalculationRegister": "РегистрРасчета", "ChartOfAccounts": "ПланСчетов", "ChartOfCharacteristicType": "ПланВидовХарактеристик",
    "ChartOfCalculationTypes": "ПланВидовРасчета", "BusinessProcess": "БизнесПроцесс", "Task": "Задача", "ExchangePlan": "ПланОбмена", "DocumentJournal": "ЖурналДокументов",
    "Constant": "Константа", "CommonModule": "ОбщийМодуль", "CommonAttribute": "ОбщийРеквизит", "DefinedType": "ОпределяемыйТип", "EventSubscription": "ПодпискаНаСобытие",
    "Role": "Роль", "Report": "Отчет", "DataProcessor": "Обработка", "Subsystem": "Подсистема", "XDTOPackage": "ПакетXDTO", "FilterCriterion": "КритерийОтбора",
    "SettingsStorage": "ХранилищеНастроек",
}


def russian_path(path) -> Column:
    """``Catalog/X/CatalogForm/Y`` as ``Справочник.X.Y``: the first type in Russian, later types left out."""
    parts = F.split(path, "/")
    names = F.filter(parts, lambda _, i: i % 2 == 1)
    table = F.create_map(*(F.lit(x) for pair in RUSSIAN.items() for x in pair))
    first = F.get(parts, F.lit(0))
    return F.when(path == "", "").otherwise(F.array_join(F.concat(F.array(F.coalesce(table[first], first)), names), "."))


def slash_path(name: str) -> str:
    """``Справочник.X`` as ``Catalog/X``; other texts stay as they are."""
    kind, dot, rest = name.partition(".")
    stem = {v.lower(): k for k, v in RUSSIAN.items()}.get(kind.strip().lower())
    return f"{stem}/{rest.strip()}" if dot and stem else name


def unquoted(text) -> Column:
    """``"a""b"`` as ``a"b``."""
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    return F.when(F.startswith(text, F.lit('"')) & F.endswith(text, F.lit('"')) & (F.length(text) >= 2), F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(text)


def compatibility(code) -> Column:
    """``80321`` as ``8.3.21``."""
    text = code.cast("string")
    return F.concat_ws(".", F.substring(text, 1, 1), F.substring(text, 2, 2).cast("int").cast("string"), F.substring(text, 4, 2).cast("int").cast("string"))


def event_name(text) -> Column:
    """What stands behind the first underscore, or the whole."""
    return F.when(F.contains(text, F.lit("_")), F.regexp_replace(text, "^[^_]*_", "")).otherwise(text)


def source_ext(path) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def local_name(qname) -> Column:
    """(prefix, name) of a qualified name, as a struct; the prefix is null without a colon."""
    return F.struct(F.when(F.contains(qname, F.lit(":")), F.substring_index(qname, ":", 1)).alias("prefix"), F.regexp_replace(qname, "^[^:]*:", "").alias("name"))


def is_uuid(text) -> Column:
    return text.rlike("^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
