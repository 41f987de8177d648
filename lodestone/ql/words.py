"""Fixed values of the query language: keywords, prefixes, virtual tables, standard fields."""

#: Reserved words (an alias without КАК cannot be one of them).
KEYWORDS = frozenset("""
ВЫБРАТЬ РАЗЛИЧНЫЕ РАЗРЕШЕННЫЕ ПЕРВЫЕ КАК ИЗ ГДЕ ПОРЯДОК УПОРЯДОЧИТЬ ПО ВОЗР УБЫВ СГРУППИРОВАТЬ СГРУППИРОВАНО ИМЕЮЩИЕ ОБЪЕДИНИТЬ ВСЕ
ВЫБОР КОГДА ТОГДА ИНАЧЕ КОНЕЦ И ИЛИ НЕ В МЕЖДУ ЕСТЬ NULL ПОДОБНО СПЕЦСИМВОЛ ПОМЕСТИТЬ УНИЧТОЖИТЬ ВЫРАЗИТЬ ЛЕВОЕ ПРАВОЕ ВНУТРЕННЕЕ ПОЛНОЕ
ВНЕШНЕЕ СОЕДИНЕНИЕ ИНДЕКСИРОВАТЬ ИТОГИ ИСТИНА ЛОЖЬ НЕОПРЕДЕЛЕНО ССЫЛКА ГРУППИРУЮЩИМ НАБОРАМ ИЕРАРХИЯ ИЕРАРХИИ АВТОУПОРЯДОЧИВАНИЕ ТОЛЬКО
ПЕРИОДАМИ ОБЩИЕ ДЛЯ ИЗМЕНЕНИЯ OF
""".split())

#: The units of periods.
UNITS = ("СЕКУНДА", "МИНУТА", "ЧАС", "ДЕНЬ", "НЕДЕЛЯ", "ДЕКАДА", "МЕСЯЦ", "КВАРТАЛ", "ПОЛУГОДИЕ", "ГОД")

#: A table's first segment and the type of object it names.
PREFIXES = {
    "Справочник": "Catalog", "Документ": "Document", "Перечисление": "Enum", "РегистрСведений": "InformationRegister",
    "РегистрНакопления": "AccumulationRegister", "РегистрРасчета": "CalculationRegister", "РегистрБухгалтерии": "AccountingRegister",
    "ПланВидовХарактеристик": "ChartOfCharacteristicType", "ПланСчетов": "ChartOfAccounts", "ПланВидовРасчета": "ChartOfCalculationTypes",
    "БизнесПроцесс": "BusinessProcess", "Задача": "Task", "ОбменДанными": "ExchangePlan", "ПланОбмена": "ExchangePlan",
    "ЖурналДокументов": "DocumentJournal", "КритерийОтбора": "FilterCriterion", "ХранилищеНастроек": "SettingsStorage", "Константа": "Constant",
}

#: Virtual tables, whose fields are not checked.
VIRTUAL = frozenset("""
СрезПервых СрезПоследних Остатки Обороты ОстаткиИОбороты ОборотыНаДату ОстаткиИОборотыНаДату Движения ДвиженияССубконто Записи Перерасчет График
ЗначенияСубконто Последовательности Приходы Расходы ПустаяСсылка
""".split())

#: Fields that every object may have.
STANDARD = frozenset(w.lower() for w in """
Ссылка Наименование Код Владелец Родитель ПометкаУдаления Предопределенный ИмяПредопределенныхДанных Дата Номер МоментВремени Период Регистратор
Активность КлючЗаписи ВидДвижения НомерСтроки Тип Значение График Порядок Счет Сумма Субконто1 Субконто2 Субконто3 Организация ЭтоГруппа Проведен
ВерсияПотока Использование Выполнена БизнесПроцесс ТочкаМаршрута ТочкаМаршрутаБизнесПроцесса Исполнитель Завершен Стартован ДатаЗавершения
СчетДт СчетКт СубконтоДт1 СубконтоДт2 СубконтоДт3 СубконтоКт1 СубконтоКт2 СубконтоКт3 ВалютаДт ВалютаКт ВалютнаяСуммаОборотДт
ВалютнаяСуммаОборотКт КоличествоОборотДт КоличествоОборотКт СуммаНУОборотДт СуммаНУОборотКт СуммаОборот СуммаПРОборотДт СуммаПРОборотКт
СуммаВРОборотДт СуммаВРОборотКт ПодразделениеКт ВидСубконто ПериодДействия ПериодДействияНачало ПериодДействияКонец ПериодРегистрации ВидРасчета
""".split())

#: Aggregate and scalar functions and what they are in SQL.
FUNCTIONS = {
    "СУММА": "sum", "КОЛИЧЕСТВО": "count", "МИНИМУМ": "min", "МАКСИМУМ": "max", "СРЕДНЕЕ": "avg", "ПОДСТРОКА": "substring",
    "ЕСТЬNULL": "coalesce", "ГОД": "year", "КВАРТАЛ": "quarter", "МЕСЯЦ": "month", "ДЕНЬ": "day", "ЧАС": "hour", "МИНУТА": "minute", "СЕКУНДА": "second",
}
SQL_UNITS = {"СЕКУНДА": "second", "МИНУТА": "minute", "ЧАС": "hour", "ДЕНЬ": "day", "НЕДЕЛЯ": "week", "МЕСЯЦ": "month", "КВАРТАЛ": "quarter", "ГОД": "year"}
