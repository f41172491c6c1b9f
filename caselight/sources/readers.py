"""Readers of case documents into one shape: ``path, parser, text, rows, parser_confidence,
needs_ocr``. All read through Spark; the kind is decided by extension and first bytes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.functions.text import clean_text, trimmed

# Parser confidences, extensions, first bytes of formats.
CONFIDENCE = {"text": 0.95, "json": 0.95, "xml": 0.90, "sheet": 0.78, "pdf": 0.72}
KINDS = {"image": ("png", "jpg", "jpeg", "bmp", "gif", "tif", "tiff", "webp"), "pdf": ("pdf",), "sheet": ("csv", "xlsx", "xls"), "json": ("json",), "xml": ("xml", "html", "htm"), "text": ("txt", "text", "md")}
MAGIC = {"PNG": "89504E47", "JPEG": "FFD8FF", "BMP": "424D", "GIF": "47494638", "TIFF": "49492A00", "TIFF-BE": "4D4D002A", "RIFF": "52494646", "PDF": "25504446"}
PDF_LEAST_CHARS = 80
FORM_TEXT = {
    "patient_initials": "Patient_Initials", "patient_age": "Patient_Age", "patient_weight": "Patient_Weight_kg", "suspect_drug": "Suspect_Drug", "reaction": "MedDRA_PT", "dose": "Drug_Dose_mg",
    "route": "Drug_Route", "frequency": "Dose_Frequency", "indication": "Indication", "onset": "Onset_Date", "report_date": "Report_Date", "reporter": "Reporter_Name", "narrative": "Narrative",
}
FORM_CHECKS = {"sex_male": ("Patient_Sex", "Male"), "sex_female": ("Patient_Sex", "Female"), "death": ("SAE_Seriousness_Criteria", "Death"), "hospitalised": ("SAE_Seriousness_Criteria", "Hospitalisation"), "disability": ("SAE_Seriousness_Criteria", "Disability/incapacity"), "recovered": ("Outcome", "Recovered"), "fatal": ("Outcome", "Fatal"), "not_recovered": ("Outcome", "Not recovered")}


def kind(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    out = F.when(F.lit(False), "")
    for name, extensions in KINDS.items():
        out = out.when(ext.isin(*extensions), name)
    return out.otherwise("text")


def magic(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 4))
    out = F.when(F.lit(False), "")
    for name, prefix in MAGIC.items():
        out = out.when(head.startswith(prefix), name)
    return out.otherwise("unknown")


def files(spark: SparkSession, path: str, names: tuple[str, ...] | None = None) -> DataFrame:
    """Files with their kinds and metadata; ``names`` is an allow-list."""
    df = spark.read.format("binaryFile").load(path)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    df = df.select("path", name.alias("name"), F.col("length").alias("bytes"), F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1)).alias("extension"), F.col("modificationTime").alias("processed_at"), kind(F.col("path")).alias("kind"), magic(F.col("content")).alias("magic"), F.sha2("content", 256).alias("source_hash"), "content")
    return df if names is None else df.where(F.col("name").isin(*names))


def markup_text(c: Column) -> Column:
    """Tags to spaces; entities and script bodies stay."""
    return clean_text(F.regexp_replace(c, r"<[^>]+>", " "))


def parsed(text: Column, parser: str, rows: Column | None = None) -> list[Column]:
    none = F.array().cast("array<map<string,string>>")
    return [F.lit(parser).alias("parser"), text.alias("text"), (none if rows is None else rows).alias("rows"), F.lit(CONFIDENCE[parser]).alias("parser_confidence"), F.lit(False).alias("needs_ocr")]


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), *parsed(clean_text(F.col("value")), "text"))


def read_markup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), *parsed(markup_text(F.col("value")), "xml"))


def json_rows(c: Column) -> Column:
    """An array's objects, or the one object, as maps of strings."""
    many = F.from_json(c, "array<map<string,string>>")
    return F.when(F.ltrim(c).startswith("["), many).otherwise(F.array(F.from_json(c, "map<string,string>")))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.text(path, wholetext=True)
    root = F.when(F.ltrim("value").startswith("["), "array").otherwise("object")
    return raw.select(F.input_file_name().alias("path"), *parsed(F.to_json(json_rows(F.col("value")), {"pretty": "true"}), "json", json_rows(F.col("value"))), root.alias("root_type"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """One row per line of a sheet, all cells strings, the sheet's name first."""
    df = spark.read.csv(path, header=True, inferSchema=False, multiLine=True).na.fill("")
    cells = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`"))])
    sheet = F.regexp_extract(F.input_file_name(), r"([^/]+)\.[^./]+$", 1)
    return df.select(F.input_file_name().alias("path"), sheet.alias("sheet_name"), F.concat_ws(" ", *[F.col(f"`{c}`") for c in df.columns]).alias("text"), F.map_concat(F.create_map(F.lit("sheetName"), sheet), cells).alias("row"), F.lit(CONFIDENCE["sheet"]).alias("parser_confidence"))


def read_with(found: DataFrame, extractor: Callable[[bytes], str]) -> DataFrame:
    """Text of binary formats (PDF, images) by a given extractor, which no library here supplies.
    Under ``PDF_LEAST_CHARS`` characters a document needs OCR; an extractor's failure on a
    document counts as no text."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in it:
            texts = []
            for content in x.content:
                try:
                    texts.append(extractor(bytes(content)))
                except ValueError:
                    texts.append("")
            yield pd.DataFrame({"path": x.path, "text": texts})

    read = found.select("path", "content").mapInPandas(run, "path string, text string").withColumn("text", clean_text(F.col("text")))
    return read.select("path", *parsed(F.col("text"), "pdf")).withColumn("needs_ocr", F.length("text") < PDF_LEAST_CHARS)


def form_text(fields: DataFrame) -> DataFrame:
    """Labelled lines from form fields ``(doc_id, field, value)``; a checkbox says its value."""
    label = F.create_map(*[x for k, v in FORM_TEXT.items() for x in (F.lit(k), F.lit(v))])
    checked = F.create_map(*[x for k, (a, b) in FORM_CHECKS.items() for x in (F.lit(k), F.struct(F.lit(a).alias("l"), F.lit(b).alias("v")))])
    on = F.lower(trimmed(F.col("value"))).isin("yes", "on", "true", "x", "1")
    line = F.when(F.try_element_at(label, F.col("field")).isNotNull(), F.concat(F.try_element_at(label, F.col("field")), F.lit(": "), "value")).when(F.try_element_at(checked, F.col("field")).isNotNull() & on, F.concat(F.try_element_at(checked, F.col("field"))["l"], F.lit(": "), F.try_element_at(checked, F.col("field"))["v"]))
    rows = fields.select("doc_id", line.alias("line")).where("line is not null")
    g = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("line")).alias("lines"))
    default = lambda a, b: F.when(F.exists("lines", lambda x: x.startswith(a + ":")), F.array().cast("array<string>")).otherwise(F.array(F.lit(f"{a}: {b}")))
    return g.select("doc_id", F.array_join(F.concat("lines", default("Patient_Sex", "Unknown"), default("SAE_Seriousness_Criteria", "Non-serious")), "\n").alias("text"))


def union_sheets(sheets: list[DataFrame]) -> DataFrame:
    out = sheets[0]
    for s in sheets[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out
