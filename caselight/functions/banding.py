"""The banding families. They disagree on purpose and are kept apart."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import text_of

# States of each zone (substring lists and exact sets differ), drug classes, outcome
# and seriousness labels.
ZONE_SUBSTRINGS = {
    "North": ("Delhi", "Haryana", "Punjab", "Rajasthan", "UP", "Uttar Pradesh", "Uttarakhand", "HP", "Himachal Pradesh", "J&K", "Jammu"),
    "South": ("Tamil Nadu", "Kerala", "Karnataka", "Andhra Pradesh", "Telangana"),
    "West": ("Maharashtra", "Gujarat", "Goa"),
    "East": ("West Bengal", "Odisha", "Bihar", "Jharkhand", "Assam", "Meghalaya"),
}
ZONE_SETS = {
    "North India": ("Delhi", "Punjab", "Haryana", "UP", "Uttarakhand", "J&K", "Himachal Pradesh"),
    "South India": ("Tamil Nadu", "Kerala", "Karnataka", "Andhra Pradesh", "Telangana"),
    "West India": ("Maharashtra", "Gujarat", "Rajasthan", "Goa"),
    "East India": ("West Bengal", "Bihar", "Odisha", "Jharkhand", "Assam"),
}
DRUG_CLASSES = {
    "Antibacterial": "Amoxicillin Ciprofloxacin Azithromycin Metronidazole Doxycycline Clindamycin Ceftriaxone Piperacillin Vancomycin Meropenem Rifampicin Pyrazinamide Ethambutol Isoniazid Linezolid",
    "Anticoagulant": "Heparin Warfarin Enoxaparin Apixaban Rivaroxaban",
    "Cardiovascular": "Atorvastatin Lisinopril Amlodipine Metoprolol Furosemide Digoxin",
    "Analgesic/NSAID": "Paracetamol Ibuprofen Diclofenac Aspirin Tramadol Morphine",
    "Antidiabetic": "Metformin Insulin Glipizide Sitagliptin Empagliflozin",
    "CNS": "Phenytoin Valproate Carbamazepine Levetiracetam Clozapine Risperidone Haloperidol Olanzapine",
    "Immunomodulator": "Methotrexate Prednisolone Dexamethasone Rituximab Infliximab",
}
SERIOUS_LABELS = ("Death", "Life-threatening", "Hospitalisation", "Required hospitalisation", "Disability/incapacity", "Congenital anomaly", "Other medically important")


def _number(c: Column) -> Column:
    """The first run of digits; zero and none are missing."""
    return F.nullif(F.regexp_extract(text_of(c), r"(\d+)", 1), F.lit("")).try_cast("long")


def _steps(value: Column, steps: list[tuple[float, str]], last: str, below: bool = False) -> Column:
    out = F.when(value.isNull() | (value == 0), "Unknown")
    for limit, name in steps:
        out = out.when(value < limit if below else value <= limit, name)
    return out.otherwise(last)


def age_band(c: Column) -> Column:
    return _steps(_number(c), [(17, "Under-18"), (35, "18-35"), (55, "36-55"), (70, "56-70")], "70+")


def weight_band(c: Column) -> Column:
    return _steps(_number(c), [(44, "<45kg"), (65, "45-65kg"), (85, "66-85kg")], "86kg+")


def eval_age_band(c: Column) -> Column:
    """The evaluation harness's bands of a number."""
    age = text_of(c).try_cast("double")
    return F.when(age.isNull() | (age == 0), "Unknown").when(age < 18, "Under-18").when(age <= 40, "18-40").when(age <= 60, "41-60").when(age <= 70, "61-70").otherwise("71+")


def study_age_band(c: Column) -> Column:
    """The privacy study's bands; zero is a child."""
    age = F.floor(text_of(c).try_cast("double"))
    return F.when(age.isNull(), "Unknown").when(age < 18, "<18").when(age < 30, "18-29").when(age < 45, "30-44").when(age < 60, "45-59").when(age < 75, "60-74").otherwise("75+")


def zone(c: Column) -> Column:
    """By substring, first list first."""
    value = text_of(c)
    out = F.when(value == "", "Unknown")
    for name, states in ZONE_SUBSTRINGS.items():
        hit = F.lit(False)
        for s in states:
            hit |= value.contains(s)
        out = out.when(hit, name)
    return out.otherwise("Central/Other")


def study_zone(c: Column) -> Column:
    value = F.trim(text_of(c))
    out = F.when(F.lower(value).isin("", "nan"), "Unknown")
    for name, states in ZONE_SETS.items():
        out = out.when(value.isin(*states), name)
    return out.otherwise("Other")


def drug_class(c: Column, default: str = "Other systemic") -> Column:
    out = F.when(F.lit(False), "")
    for name, drugs in DRUG_CLASSES.items():
        out = out.when(F.trim(text_of(c)).isin(*drugs.split()), name)
    return out.otherwise(default)


def outcome_band(c: Column) -> Column:
    value = text_of(c)
    return F.when(value == "", "Unknown").when(value.isin("Fatal", "Death"), "Fatal").when(value.isin("Recovered", "Recovering"), "Recovered").otherwise("Not-recovered/Unknown")


def study_outcome_band(c: Column) -> Column:
    """By substring; "recover" is tried first, so "Not recovered" counts as recovered."""
    low = F.lower(F.trim(text_of(c)))
    return F.when(low.rlike("recover|resolved"), "Recovered").when(low.contains("resolving"), "Recovering").when(low.contains("ongoing"), "Not Recovered").when(low.rlike("fatal|death|died"), "Fatal").otherwise("Unknown")


def seriousness_band(c: Column) -> Column:
    value = text_of(c)
    return F.when(value == "", "Unknown").when(value.isin(*SERIOUS_LABELS), "Serious").otherwise("Non-serious")


def study_seriousness_band(c: Column) -> Column:
    low = F.lower(F.trim(text_of(c)))
    return F.when(low.rlike("death|life-threatening|fatal"), "death").when(low.rlike("disability|incapacity|congenital"), "disability").when(low.contains("hospital"), "hospitalisation").otherwise("others")


def score_band(c: Column) -> Column:
    return F.when(c < 40, "0-39").when(c < 70, "40-69").when(c < 90, "70-89").otherwise("90-100")


def decile(c: Column, width: float) -> Column:
    return F.least(F.lit(9), F.floor(c / width)).cast("int")
