"""Names of access rights, a reference table for left joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A right's uuid and its name. Rights that are not here are shown by the
#: first eight digits of their uuid.
RIGHT_NAMES = {
    "24abfe06-289a-48c5-8bb4-032c733e45c5": "Чтение",
    "479a42c0-c3e9-4ae7-bf4a-75cebc14fec4": "Чтение",
    "74fd69fa-368e-4292-956a-65eb2f9877bd": "Чтение",
    "b7bab52d-c1b1-4bd8-8276-02db08d42352": "Просмотр",
    "b162ff57-0296-483e-9af8-dc37576802cb": "Просмотр",
    "b5f861d3-d9c5-45ec-98bf-0ed4d489a351": "Просмотр",
    "c6de80da-a4f7-4ce9-bbeb-0b00ea564ec1": "Просмотр",
    "d76b72ba-5388-4b7f-af64-1b351f63a1e1": "Просмотр",
    "fa6dbe86-856a-4ac4-b8ac-bce99f8b8b22": "Просмотр",
    "aa6448f2-be0f-42ea-ba26-1af7f52b5b65": "Редактирование",
    "1b762bf9-df7f-4255-bbe6-f7578f41368d": "Редактирование",
    "1c87578f-9e09-4ec0-a991-5629c87b1588": "Редактирование",
    "013a262e-165f-4815-bdae-7a1bed6a68e4": "Удаление",
    "5d167fcc-b11f-403a-9a37-1eda64c19df1": "ИнтерактивноеДобавление",
    "8497054a-ffd1-4ca7-bdfe-340b9ddc050a": "Изменение",
    "f55a8f7f-2c65-404f-b530-093d9006adba": "Изменение",
    "1d306db2-d97e-4b57-9b6f-951a009228ce": "Получение",
    "499e8968-ca89-43f0-9955-8756058b1b53": "Установка",
    "21b4742a-d335-4234-bf0f-a3074a0e31ac": "ВводПоСтроке",
    "e060de25-bffd-42fd-bb09-f3a788d65760": "ОтменаПроведения",
    "798cf688-ad74-44fe-a464-236b49e910e0": "ИнтерактивнаяПометкаУдаления",
    "b0c0cbfc-f2cc-4b80-8460-5d5d7a599d9d": "ИнтерактивнаяПометкаУдаления",
    "84487e82-eb6c-4c51-ae16-3a6db17e886d": "ИнтерактивнаяПометкаУдаления",
    "33200740-82b0-4de7-8556-d3fb25ca4328": "ИнтерактивноеСнятиеПометкиУдаления",
    "408c56c0-e210-4e2e-8e82-610050a08a39": "ИнтерактивноеСнятиеПометкиУдаления",
    "4d0d77ec-8511-430d-bd77-8407f27bc8f4": "ИнтерактивноеСнятиеПометкиУдаления",
    "65b6855f-85d5-4d33-ab75-be4485326dd5": "ИнтерактивноеСнятиеПометкиУдаления",
    "65e5f92c-40ff-4130-9652-c0e7612d0609": "ИнтерактивноеУдалениеПредопределённыхДанных",
    "3b869658-ebc9-49ff-9bb3-e7c59686f538": "ИнтерактивнаяАктивизация",
    "5b3ea0e2-fdb9-41f6-bf6c-25747906b4cb": "ЧтениеИсторииДанных",
    "b53db6ed-6e5b-4035-8d24-f10083d646ed": "ЧтениеИсторииДанныхОтсутствующихДанных",
    "9342b152-a7ae-4c79-9b7b-f4f028a36479": "ОбновлениеИсторииДанных",
    "c0028105-4cc1-41ca-aef1-bfbd8fc8f8c4": "ОбновлениеИсторииДанных",
    "c4ab1331-e58d-4a46-ad2e-fe6d80b72aa4": "ПросмотрИсторииДанных",
    "fb88c756-91c9-4351-9cdf-e027879886c6": "ПросмотрИсторииДанных",
    "64319ca1-f3d8-472e-82ce-5da233e6daaa": "ПереключениеНаВерсиюИсторииДанных",
    "287b74b8-3a66-4a76-ba27-4f1f6a93770e": "РедактированиеКомментарияВерсииИсторииДанных",
    "e7f9daf9-eac2-4ada-9c26-c380858f3589": "ОбновлениеКомментарияВерсииИсторииДанных",
    "a679c969-8ea1-4b8b-9e61-8a414ba448f4": "ОбновлениеНастроекИсторииДанных",
    "02119c69-f08a-4142-9426-3725d74b7719": "Администрирование",
    "07ef4641-f7da-417a-bd75-35c40a17c2f7": "КлиентАналитическойСистемы",
    "10b8ce49-ae3d-4a2e-afe7-1e3648bd59f7": "ОсновнойРежимОкнаВстроенноеРабочееМесто",
    "155a0b35-4343-4047-989b-d385373b063e": "ОсновнойРежимОкнаПолноэкранноеРабочееМесто",
    "1c799cf9-342d-4bf7-9b6f-951a009228ce": "ОсновнойРежимОкнаКиоск",
    "1e50809b-73ed-4935-bb77-2616c4cabdf5": "ОсновнойРежимОкнаНормальный",
    "265eec41-3ce1-4a07-bc3b-253d44c9a4f4": "ОсновнойРежимОкнаРабочееМесто",
    "29da0973-3b85-40e5-89da-bce02dbab08e": "Использование",
    "3762abec-3836-446a-83ce-3e05001bca8b": "Добавление",
    "4df6d046-3bf8-4dda-991c-53ba664296a5": "ИнтерактивноеВыполнение",
    "5e664189-f0ee-439c-bdc5-eb81cca41ddf": "ИнтерактивноеОткрытиеВнешнихОтчётов",
    "669fef9d-9d4c-4333-8237-66351429d935": "ИнтерактивнаяПометкаУдаленияПредопределённыхДанных",
    "900e3c92-6e18-4874-846a-b28780b5b54c": "МобильныйКлиент",
    "963624dc-9b02-4c20-a3f0-015ac64c6d81": "Проведение",
    "b9b44b51-3ac9-47cd-8b5a-df51afdcceb0": "Запуск",
    "d066966a-ff6a-4a41-bd68-6191cab083bc": "УправлениеИтогами",
    "eb29e198-c338-4a20-a253-be6fc3dd44d9": "ОбновлениеИсторииДанныхОтсутствующихДанных",
    "fd05f656-7a23-43a4-8996-f480a806fb97": "ВебКлиент",
}


def right_names(spark: SparkSession) -> DataFrame:
    """(right_uuid, right_name); several uuids can have one name."""
    return spark.createDataFrame(list(RIGHT_NAMES.items()), "right_uuid string, right_name string")


def with_right_names(rights: DataFrame, uuid: str = "right_uuid") -> DataFrame:
    """``rights`` with right_name (null if unknown) and right_label (name, or the uuid's head)."""
    names = F.broadcast(right_names(rights.sparkSession)).withColumnRenamed("right_uuid", "__uuid")
    both = rights.join(names, F.lower(uuid) == F.col("__uuid"), "left").drop("__uuid")
    return both.withColumn("right_label", F.coalesce("right_name", F.left(uuid, F.lit(8))))
