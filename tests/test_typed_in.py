"""Small inputs typed in, with the rows that must come out: what the given tables lack. Each is SQL of constant rows."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F
from caselight.functions import text
from caselight.functions import banding
from caselight.operators import documents as docs_ops
from caselight.operators import severity
from caselight.operators import extraction
from caselight.operators import summary
from caselight.operators import identifiers
from caselight.operators import casepages
from caselight.operators import evaluation
from caselight.sources import readers
from caselight.plans.q_text import KEY, TRIM, VALUE, inline, values
from caselight.operators import forms
from caselight.plans.q_text import inline
from caselight.plans.q_text import values
from caselight.operators import paging

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, oracle):
    def put(f):
        QUERIES[name], SQL[name] = f, oracle
        return f

    return put


_STRINGS = [(1, "  Rash :: "), (2, "Reporting Form"), (3, "x" * 95 + " traceid"), (4, "mg"), (5, None), (6, "a\t b\n c ||"), (7, "Suspected Medication(s)"), (8, "HIV-Positive  Case!")]


@query("string_rules", f"SELECT id, {VALUE.format('s')} AS value, CASE WHEN lower({VALUE.format('s')}) IN ('date', 'reaction', 'mg', 'reporting form', 'suspected adverse drug reaction', 'suspected medication(s)', 'suspected adverse reaction perit') OR length({VALUE.format('s')}) > 90 AND regexp_matches(lower({VALUE.format('s')}), 'adr_form|reporting form|sourcefile|traceid') THEN '' ELSE {VALUE.format('s')} END AS exact, {TRIM.format(chr(39).join(['regexp_replace(lower(s), ', '[^a-z0-9_]+', ', ', ' ', ', ', 'g', ')']))} AS label, {KEY.format('s')} AS key FROM (SELECT id, coalesce(s, '') AS s FROM {values(_STRINGS, 'id, s')})")
def string_rules(spark, sf):
    c = F.col("s")
    return inline(spark, _STRINGS, "id int, s string").select("id", text.clean_value(c).alias("value"), text.exact_string(c).alias("exact"), text.label_key(c).alias("label"), text.value_key(c).alias("key"))


_CER = [(1, "Severe Rash", "severe  rash"), (2, "severe rush.", "severe rash"), (3, "abc", ""), (4, "", "abc")]


@query("cer", f"SELECT * FROM {values([(1, 0.0), (2, 0.1818), (3, None), (4, 1.0)], 'id, cer')}".replace("SELECT *", "SELECT id, CAST(cer AS DOUBLE) AS cer"))
def cer(spark, sf):
    return inline(spark, _CER, "id int, ocr string, truth string").select("id", text.cer(F.col("ocr"), F.col("truth")).alias("cer"))


_PEOPLE = [(1, "17"), (2, "18 years"), (3, "0"), (4, ""), (5, None), (6, "aged 70"), (7, "71"), (8, "40"), (9, "61.5"), (10, "nan"), (11, "5")]


@query("age_strings", f"SELECT * FROM {values([(1, 'Under-18'), (2, '18-35'), (3, 'Unknown'), (4, 'Unknown'), (5, 'Unknown'), (6, '56-70'), (7, '70+'), (8, '36-55'), (9, '56-70'), (10, 'Unknown'), (11, 'Under-18')], 'id, band')}")
def age_strings(spark, sf):
    return inline(spark, _PEOPLE, "id int, age string").select("id", banding.age_band(F.col("age")).alias("band"))


_PLACES = [("Jaipur, Rajasthan", "Amoxicillin"), ("Rajasthan", " Heparin "), ("Kerala", "Digoxin"), ("Meghalaya", "Other"), ("", ""), (None, None), ("Goa", "Insulin"), ("Nagaland", "Clozapine"), ("West Bengal", "Rituximab"), ("Delhi", "Morphine")]


_ZONES = [("Jaipur, Rajasthan", "North", "Other", "Antibacterial"), ("Rajasthan", "North", "West India", "Anticoagulant"), ("Kerala", "South", "South India", "Cardiovascular"), ("Meghalaya", "East", "Other", "Other systemic"), ("", "Unknown", "Unknown", "Other systemic"), (None, "Unknown", "Unknown", "Other systemic"), ("Goa", "West", "West India", "Antidiabetic"), ("Nagaland", "Central/Other", "Other", "CNS"), ("West Bengal", "East", "East India", "Immunomodulator"), ("Delhi", "North", "North India", "Analgesic/NSAID")]


@query("zones_and_drugs", f"SELECT * FROM {values(_ZONES, 'place, zone, study_zone, drug_class')}")
def zones_and_drugs(spark, sf):
    c = F.col("place")
    return inline(spark, _PLACES, "place string, drug string").select("place", banding.zone(c).alias("zone"), banding.study_zone(c).alias("study_zone"), banding.drug_class(F.col("drug")).alias("drug_class"))


_FILES = [("a/Report.PDF", "25504446"), ("b/x.csv", "41"), ("c/y.Json", "7B"), ("d/z.html", "3C"), ("e/scan.jpeg", "FFD8FFE0"), ("f/readme", "61"), ("g/p.png", "89504E47"), ("h/t.tiff", "4D4D002A")]


@query("file_kinds", f"SELECT * FROM {values([('a/Report.PDF', 'pdf', 'PDF'), ('b/x.csv', 'sheet', 'unknown'), ('c/y.Json', 'json', 'unknown'), ('d/z.html', 'xml', 'unknown'), ('e/scan.jpeg', 'image', 'JPEG'), ('f/readme', 'text', 'unknown'), ('g/p.png', 'image', 'PNG'), ('h/t.tiff', 'image', 'TIFF-BE')], 'path, kind, magic')}")
def file_kinds(spark, sf):
    return inline(spark, _FILES, "path string, head string").select("path", readers.kind(F.col("path")).alias("kind"), readers.magic(F.unhex("head")).alias("magic"))


_FORM = [(1, "patient_age", "54"), (1, "sex_male", "Yes"), (1, "death", "Off"), (1, "suspect_drug", "Warfarin"), (1, "junk", "x"), (2, "hospitalised", "On"), (2, "reaction", "rash")]


@query("form_text", f"SELECT * FROM {values([(1, chr(10).join(['Patient_Age: 54', 'Patient_Sex: Male', 'Suspect_Drug: Warfarin', 'SAE_Seriousness_Criteria: Non-serious'])), (2, chr(10).join(['MedDRA_PT: rash', 'SAE_Seriousness_Criteria: Hospitalisation', 'Patient_Sex: Unknown']))], 'doc_id, text')}")
def form_text(spark, sf):
    return readers.form_text(inline(spark, _FORM, "doc_id int, field string, value string"))


_NARRATIVE = "Patient received Warfarin and was reported bleeding after exposure to Warfarin."


MACHINE = f"""Page 2
{casepages.MARKER}
Patient_Token: PATIENT_TKN_1
Patient_Initials: A.B.
Patient_Age: 54
Patient_Sex: Male
Patient_Weight_kg: 70.5
Suspect_Drug: Warfarin
MedDRA_PT: Bleeding
Drug_Dose_mg: 5 mg
Drug_Route: Oral
Dose_Frequency: OD
Outcome: Recovering
Reporter_Name: Dr Rao
SAE_Seriousness_Criteria: Hospitalisation
Onset_Date: 2025-01-02
Narrative: {_NARRATIVE}"""


FREE = """Patient name: J K
Age: 61 years
male patient, weight: 80
Suspected drug: Metformin
Reaction: lactic acidosis
Reporter name: Dr Iyer
Contact No: +91 98765 43210
mail iyer@clinic.example
Outcome was not recovered; life-threatening event
Dose: 500 mg
Date: 03/02/2025"""


_CASES = [(1, MACHINE), (2, FREE), (3, ""), (4, None)]


_EXTRACTED = [
    (1, "A.B.", "54", "Male", "70.5", "Warfarin", "Bleeding", "5 mg", "Oral", "OD", "Recovering", "Hospitalisation", "Dr Rao", "", "PATIENT_TKN_1", "36-55"),
    (2, "J K Age", "61", "male", "80", "Metformin", "lactic acidosis", "500 mg", "", "", "Not recovered", "Life-threatening", "Dr Iyer", "iyer@clinic.example", None, "56-70"),
    (3, "", "", "", "", "", "", "", "", "", "", "", "", "", "", "Unknown"),
    (4, "", "", "", "", "", "", "", "", "", "", "", "", "", "", "Unknown"),
]


_NAMES = "doc_id initials age gender weight medicine reaction dose route frequency outcome seriousness reporter email patient_token age_band".split()


@query("extract_fields", f"SELECT * REPLACE (CASE doc_id WHEN 2 THEN 'PATIENT_TKN_' || upper(substr(sha256('patient:J K Age|61|male|80'), 1, 10)) ELSE patient_token END AS patient_token) FROM {values(_EXTRACTED, ', '.join(_NAMES))}")
def extract_fields(spark, sf):
    out = extraction.extract(inline(spark, _CASES, "doc_id int, text string"))
    return out.select(*_NAMES)


@query("source_trace", f"SELECT doc_id, count(*) AS fields, count(*) FILTER (WHERE v <> '') AS found FROM (SELECT doc_id, unnest([initials, age, gender, weight, medicine, reaction, dose, route, frequency, outcome, seriousness, reporter, email, CASE doc_id WHEN 2 THEN '+91 98765 43210' WHEN 1 THEN '2025-01-02' ELSE '' END]) AS v FROM {values(_EXTRACTED, ', '.join(_NAMES))}) GROUP BY 1")
def source_trace(spark, sf):
    t = extraction.source_trace(extraction.extract(inline(spark, _CASES, "doc_id int, text string")))
    return t.groupBy("doc_id").agg(F.count("*").alias("fields"), F.count_if(F.col("confidence") > 0).alias("found"))


_EVAL = [(1, "A 45-year-old female had a rash and recovered."), (2, "age: 7, boy, seizure, fatal"), (3, "nothing here"), (4, "62 M with acute kidney injury; not recovered; required hospitalisation")]


@query("evaluation_fields", f"SELECT * FROM {values([(1, None, 'female', 'Rash', 'Recovered/Resolved', None), (2, '7', 'male', 'Seizure', 'Fatal', 'Death'), (3, None, None, None, None, None), (4, '62', 'male', 'Acute Kidney Injury', 'Not Recovered/Not Resolved', 'Required hospitalisation')], 'doc_id, age, sex, reaction, outcome, seriousness')}")
def evaluation_fields(spark, sf):
    return extraction.evaluation_fields(inline(spark, _EVAL, "doc_id int, text string"))


_FOUND = [(1, "Aadhaar 1234 5678 9012 and 1234 5678 9013, PAN ABCDE1234F"), (2, "call 9876543210, MRN-12345, mail a@b.org"), (3, "Patient name: X, village Y, HIV positive"), (4, "éHIVé neighbour"), (5, None), (6, "order 49876543210")]


def _tkn(prefix: str, v: str) -> str:
    return f"'{prefix.upper()}_TKN_' || upper(substr(sha256('{prefix}:{v}'), 1, 10))"


_FINDINGS = " UNION ALL ".join(
    f"SELECT {i} AS doc_id, {p} AS position, '{e}' AS entity, '{t}' AS type, '{a}' AS action, {k} AS token"
    for i, p, e, t, a, k in [
        (1, 0, "Aadhaar-like number (2 occurrence(s))", "PII", "Redact", _tkn("aadhaar", "1234 5678 9012")),
        (1, 1, "PAN-like number (1 occurrence(s))", "PII", "Redact", _tkn("pan", "ABCDE1234F")),
        (2, 0, "Indian phone number (1 occurrence(s))", "PII", "Tokenise", _tkn("phone", "9876543210")),
        (2, 1, "Medical Record Number (1 occurrence(s))", "PHI", "Tokenise", _tkn("mrn", "MRN-12345")),
        (2, 2, "Email address (1 occurrence(s))", "PII", "Tokenise", _tkn("email", "a@b.org")),
        (3, 0, "Address/location text", "PII/PHI", "Generalise", _tkn("location", "Patient name: X, village Y, HIV positive")),
        (3, 1, "Sensitive disease indication", "PHI", "Tag", _tkn("sensitive-disease", "HIV")),
        (3, 2, "Patient/reporter name field detected in text", "PII", "Tokenise", _tkn("name", "name-field")),
        (4, 0, "Sensitive disease indication", "PHI", "Tag", _tkn("sensitive-disease", "HIV")),
    ]
)


@query("identifier_findings", _FINDINGS)
def identifier_findings(spark, sf):
    return identifiers.findings(inline(spark, _FOUND, "doc_id int, text string"))


@query("anonymisation_samples", f"SELECT doc_id, position, '[' || entity || ']' AS raw, token AS pseudo, CASE WHEN action = 'Generalise' THEN 'LOCATION_GENERALISED' WHEN type = 'PHI' THEN 'PHI_CATEGORY_PRESERVED' ELSE 'TOKEN_APPLIED' END AS anon FROM ({_FINDINGS}) WHERE position < 2")
def anonymisation_samples(spark, sf):
    return identifiers.samples(identifiers.findings(inline(spark, _FOUND, "doc_id int, text string")))


_OCR = [(1, [("call", 0.9, 0, 0, 10, 5), ("9876543210", 0.8, 12, 0, 40, 5), ("now", 0.4, 42, 0, 50, 5), ("PAN", 0.7, 0, 8, 9, 12), ("ABCDE1234F", 0.6, 10, 8, 30, 13)]), (2, [("none", 0.2, 0, 0, 1, 1)]), (3, [])]


_OCR_SCHEMA = "doc_id long, words array<struct<text:string,confidence:double,x0:int,y0:int,x1:int,y1:int>>"


@query("pii_boxes", f"SELECT * FROM {values([(1, 'Indian phone', 0, 0, 40, 5, 2), (1, 'PAN', 0, 0, 50, 13, 3)], 'doc_id, kind, x0, y0, x1, y1, words')}")
def pii_boxes(spark, sf):
    return summary.pii_boxes(inline(spark, _OCR, _OCR_SCHEMA))


@query("ocr_confidence", f"SELECT doc_id, CAST(confidence AS DOUBLE) AS confidence FROM {values([(1, 0.75), (2, 0.3), (3, 0.3)], 'doc_id, confidence')}")
def ocr_confidence(spark, sf):
    return summary.ocr_confidence(inline(spark, _OCR, _OCR_SCHEMA))


_LIST = [(1, "[x] Application form attached\n[ ] Fee receipt\n1. Ethics approval pending\n- Protocol submitted\n* Investigator brochure\nshort"), (2, "Stability data not provided\n\n2) Annexure enclosed")]


@query("checklist", f"SELECT * FROM {values([(1, 0, 'Application form attached', 'provided', 'No action'), (1, 1, '[ ] Fee receipt', 'missing', 'Request from applicant'), (1, 2, 'Ethics approval pending', 'incomplete', 'Review and complete'), (1, 3, 'Protocol submitted', 'provided', 'No action'), (1, 4, 'Investigator brochure', 'review', 'No action'), (2, 0, 'Stability data not provided', 'missing', 'Request from applicant'), (2, 1, 'Annexure enclosed', 'provided', 'No action')], 'doc_id, position, item, status, action')}")
def checklist(spark, sf):
    return docs_ops.checklist(inline(spark, _LIST, "doc_id int, text string"))


@query("checklist_counts", f"SELECT * FROM {values([(1, 5, 2, 1, 1), (2, 2, 1, 1, 0)], 'doc_id, items, provided, missing, incomplete')}")
def checklist_counts(spark, sf):
    return docs_ops.checklist_counts(docs_ops.checklist(inline(spark, _LIST, "doc_id int, text string")))


_MEETING = [(1, "Decision: approve batch 7\nAction - A to call B\nPending: stability data\nNext steps: meet on Monday\nAgreed. Close item 4\nremarks only")]


@query("meeting", f"SELECT * FROM {values([(1, 0, 'decision', 'approve batch 7'), (1, 1, 'action', 'A to call B'), (1, 2, 'pending', 'stability data'), (1, 3, 'next', 'meet on Monday'), (1, 4, 'decision', 'Close item 4')], 'doc_id, position, kind, entry')}")
def meeting(spark, sf):
    return docs_ops.meeting(inline(spark, _MEETING, "doc_id int, text string"))


_NOTES = [(1, "1. Sterility failure observed in room 4\nCalibration overdue for balance 3\nHousekeeping needs work on level two\nGeneral remarks of the day were made\n- deviation in batch record incomplete"), (2, "The visit went on quietly and all was in order today"), (3, "tiny")]


_CLASSED = [(1, 0, "critical", "premises"), (1, 1, "major", "equipment"), (1, 4, "major", "manufacturing"), (2, 0, "minor", "documentation")]


def _classed(spark):
    return docs_ops.deficiencies(docs_ops.observations(inline(spark, _NOTES, "doc_id int, text string")))


@query("inspection_class", f"SELECT * FROM {values(_CLASSED, 'doc_id, position, severity, section')}")
def inspection_class(spark, sf):
    return _classed(spark).select("doc_id", "position", "severity", "section")


@query("inspection_summary", f"SELECT * FROM {values([(1, 3, 1, 2, 0, 'Reject / Immediate Action Required'), (2, 1, 0, 0, 1, 'Acceptable with Minor Observations')], 'doc_id, observations, critical, major, minor, recommendation')}")
def inspection_summary(spark, sf):
    return docs_ops.inspection_summary(_classed(spark))


@query("inspection_template", "SELECT status, count(*) AS sections FROM (VALUES ('observations-found', 4), ('no-observations', 4), ('observations-found', 2), ('no-observations', 6), ('pending', 8)) AS t(status, k), range(8) AS g(i) WHERE i < k GROUP BY 1")
def inspection_template(spark, sf):
    t = docs_ops.inspection_template(inline(spark, _NOTES, "doc_id int, text string"), _classed(spark))
    return t.groupBy("status").agg(F.count("*").alias("sections"))


_V1 = [(1, "Intro text stays here.\nSection One\nThe dose is five mg daily. Patients were well.\nSection Two\nOld words stand in this part only."), (2, "same text"), (3, "Section A\nalpha beta gamma delta epsilon zeta eta theta iota kappa")]


_V2 = [(1, "Intro text stays here.\nSection One\nThe dose is six mg daily. Patients were well.\nSection Three\nEntirely new part."), (2, "same text"), (3, "Section A\nalpha beta gamma delta epsilon zeta eta theta iota kappa lambda")]


@query("doc_compare", f"SELECT doc_id, section, change, CAST(similarity AS DOUBLE) AS similarity, materiality FROM {values([(1, 'Section One', 'modified', 0.75, 'medium'), (1, 'Section Two', 'removed', 0.0, 'high'), (1, 'Section Three', 'added', 0.0, 'high'), (3, 'Document', 'modified', 0.917, 'cosmetic')], 'doc_id, section, change, similarity, materiality')}")
def doc_compare(spark, sf):
    return docs_ops.compare(inline(spark, _V1, "doc_id int, text string"), inline(spark, _V2, "doc_id int, text string")).drop("a", "b")


@query("doc_verdict", f"SELECT * FROM {values([(1, 3, 1, 1, 1, 2, 0, 'substantive', '1 section(s) added, 1 section(s) removed, 1 section(s) modified, 2 substantive change(s).'), (3, 1, 0, 0, 1, 0, 1, 'cosmetic', '1 section(s) modified.')], 'doc_id, changes, added, removed, modified, material, cosmetic, verdict, summary')}")
def doc_verdict(spark, sf):
    return docs_ops.verdict(docs_ops.compare(inline(spark, _V1, "doc_id int, text string"), inline(spark, _V2, "doc_id int, text string")))


_TEXTS = [(1, "", "Fatal", ""), (2, "", "", "patient was admitted to ICU"), (3, "", "", "permanent harm, then died"), (4, "Unknown", "", "mild itch"), (5, "", "", ""), (6, "", "Recovered with sequelae", "admitted")]


@query("severity_text", f"SELECT case_key, class, basis, CAST(confidence AS DOUBLE) AS confidence FROM {values([(1, 'death', 'outcome-label-map', 0.9), (2, 'hospitalisation', 'text-pattern', 0.8), (3, 'death', 'text-pattern', 0.82), (4, 'others', 'seriousness-label-others', 0.7), (5, 'others', 'no-seriousness-data', 0.4), (6, 'disability', 'outcome-label-map', 0.9)], 'case_key, class, basis, confidence')}")
def severity_text(spark, sf):
    rows = inline(spark, _TEXTS, "case_key int, seriousness string, outcome string, narrative string").withColumn("reaction", F.lit(""))
    return severity.cascade(rows)


_IDF = [("rash", 1.5), ("fatal", 2.0), ("rash fatal", 3.0)]


_COEF = [("death", "fatal", 2.0), ("death", "rash", -1.0), ("others", "rash", 1.0), ("others", "rash fatal", -2.0), ("others", "fatal", 0.0), ("death", "rash fatal", 0.5)]


@query("lr_score", f"SELECT id, class, CAST(confidence AS DOUBLE) AS confidence FROM {values([(1, 'others', 0.8808), (2, 'death', 0.8981)], 'id, class, confidence')}")
def lr_score(spark, sf):
    rows = inline(spark, [(1, "Rash rash"), (2, "rash, fatal")], "id int, text string")
    idf, coef = inline(spark, _IDF, "gram string, idf double"), inline(spark, _COEF, "class string, gram string, coef double")
    start = inline(spark, [("death", 0.0), ("others", 0.0)], "class string, intercept double")
    return severity.lr_score(severity.lr_features(rows, idf, "id", "text"), coef, start, "id")


_GOLD = [("45", "45", "female", "male"), (None, "7", "male", "male"), ("62", "62", None, None), ("9", "", "male", "Male")]


@query("field_metrics", f"SELECT field, tp, fp, fn, CAST(precision AS DOUBLE) AS precision, CAST(recall AS DOUBLE) AS recall, CAST(f1 AS DOUBLE) AS f1 FROM {values([('age', 2, 1, 1, 0.6667, 0.6667, 0.6667), ('sex', 2, 1, 0, 0.6667, 1.0, 0.8), ('micro', 4, 2, 1, 0.6667, 0.8, 0.7273)], 'field, tp, fp, fn, precision, recall, f1')}")
def field_metrics(spark, sf):
    return evaluation.fields(inline(spark, _GOLD, "x_age string, g_age string, x_sex string, g_sex string"), ["age", "sex"])


_ROWS = [(1, "2025-01-09", "Aspirin, Metformin; Heparin ,Digoxin"), (2, "09/01/2025", ""), (3, "January", None), (4, None, "Insulin")]


@query("form_fields", f"SELECT * FROM {values([(1, '2025', '01', '09', 4, 'Aspirin', 'Metformin', 'Heparin'), (2, '2025', '01', '09', 0, '', '', ''), (3, '', '', 'January', 0, '', '', ''), (4, '', '', '', 1, 'Insulin', '', '')], 'id, year, month, day, n_drugs, drug_1, drug_2, drug_3')}")
def form_fields(spark, sf):
    return forms.form_fields(inline(spark, _ROWS, "id int, onset string, concomitant string"))


_FORMS = [("Male", "M", "Non-serious", "non serious", "rash", "Date"), ("Female", "male", "Death", "", "", "itch"), ("", "", "Death", "death", "fever", "fever!")]


_FORM_SCHEMA = "e_sex string, a_sex string, e_seriousness string, a_seriousness string, e_reaction string, a_reaction string"


_FIELDS = ["sex", "seriousness", "reaction"]


@query("form_accuracy", f"SELECT field, compared, matched, CAST(accuracy AS DOUBLE) AS accuracy FROM {values([('sex', 3, 2, 0.6667), ('seriousness', 3, 2, 0.6667), ('reaction', 3, 1, 0.3333)], 'field, compared, matched, accuracy')}")
def form_accuracy(spark, sf):
    return forms.form_accuracy(inline(spark, _FORMS, _FORM_SCHEMA), _FIELDS)


@query("form_errors", f"SELECT * FROM {values([('wrong_value', 1), ('missing_extraction', 1), ('unexpected_extraction', 1), ('template_label_extracted', 1)], 'error, n')}")
def form_errors(spark, sf):
    return forms.form_errors(inline(spark, _FORMS, _FORM_SCHEMA), _FIELDS)


_GOLD_ROWS = [(1, "M", "45.0", "recovering", " Death "), (2, "woman", "x", "Not recovered", ""), (3, None, None, None, None), (4, "Male", " 7 ", "died", "Non-serious")]


@query("gold_labels", f"SELECT * FROM {values([(1, 'male', '45', 'Recovered/Resolved', 'Death'), (2, 'female', None, 'Not Recovered/Not Resolved', None), (3, None, None, None, None), (4, 'male', '7', 'Fatal', 'Non-serious')], 'id, sex, age, outcome, seriousness')}")
def gold_labels(spark, sf):
    return forms.gold(inline(spark, _GOLD_ROWS, "id int, sex string, age string, outcome string, seriousness string"))


_VALUES = [("PII", "MRN 4421"), ("PII", "A. Kumar"), ("PHI", "HIV"), ("Other", "x")]


@query("generalised_values", f"SELECT * FROM {values([('PII', 'MRN 4421', 'NUMERIC_ID_REDACTED', 0.95), ('PII', 'A. Kumar', 'PERSONAL_NAME_REDACTED', 0.95), ('PHI', 'HIV', 'HEALTH_INFO_REDACTED', 0.85), ('Other', 'x', 'REDACTED', 0.85)], 'kind, value, anon, confidence')}".replace("SELECT *", "SELECT kind, value, anon, CAST(confidence AS DOUBLE) AS confidence"))
def generalised_values(spark, sf):
    k = F.col("kind")
    return inline(spark, _VALUES, "kind string, value string").select("kind", "value", identifiers.generalised(k, F.col("value")).alias("anon"), F.when(k == "PII", 0.95).otherwise(0.85).alias("confidence"))


@query("section_keys", f"SELECT * FROM {values([('Introduction',), ('Section One',), ('Section Two',), ('Section Three',)], 'section')}")
def section_keys(spark, sf):
    keys = [docs_ops.sections(inline(spark, v[:1], "doc_id int, text string")).select("section") for v in (_V1, _V2)]
    return keys[0].union(keys[1]).distinct()


@query("guideline_upsert", "SELECT version, CAST(threshold AS DOUBLE) AS threshold FROM (VALUES ('v1', 0.7), ('v2', 0.65), ('v3', 0.5)) AS t(version, threshold)")
def guideline_upsert(spark, sf):
    old = spark.sql("SELECT * FROM VALUES ('v1', 0.6D), ('v2', 0.65D) AS t(version, threshold)")
    new = spark.sql("SELECT * FROM VALUES ('v1', 0.7D), ('v3', 0.5D) AS t(version, threshold)")
    return paging.upserted(old, new)


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return str(v)[:19] if hasattr(v, "isoformat") else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_typed_in(spark, name):
    df = QUERIES[name](spark, "/root/testdata/sf0.001")
    columns = sorted(df.columns)
    con = duckdb.connect()
    con.execute(SQL[name])
    names = [x[0] for x in con.description]
    assert sorted(names) == columns
    want = sorted(tuple(plain(r[names.index(c)]) for c in columns) for r in con.fetchall())
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want
