"""Fixed schemas and constants. Optional columns are always there, as typed nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = "subject_id long, hadm_id long, time timestamp_ntz, seq long, code string, code_type int, age int"
PATIENT = "subject_id long, anchor_age int, anchor_year int, year_of_birth int, dod timestamp_ntz"
STAY = (
    "stay_id long, subject_id long, hadm_id long, intime timestamp_ntz, outtime timestamp_ntz, admittime timestamp_ntz, dischtime timestamp_ntz, deathtime timestamp_ntz, "
    "dod timestamp_ntz, death_time timestamp_ntz, in_hosp_mortality int, mortality_28d int, hospital_expire_flag int, admission_type string, admission_location string, "
    "discharge_location string, insurance string, language string, marital_status string, race string"
)
ICUSTAYS = "subject_id long, hadm_id long, stay_id long, intime timestamp_ntz, outtime timestamp_ntz"
ADMISSIONS = (
    "subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz, deathtime timestamp_ntz, hospital_expire_flag int, admission_type string, "
    "admission_location string, discharge_location string, insurance string, language string, marital_status string, race string"
)
#: The columns of an image index.
IMAGE = (
    "stay_id long, subject_id long, hadm_id long, study_id long, dicom_id string, StudyDateTime timestamp_ntz, hours_from_icu_intime double, image_rank_in_stay int, is_first_image int, "
    "is_first_24h_image int, jpg_path string, jpg_path_exists boolean, path string, delta_t string, delta_t_days double, study_in_icu_csn string, full_report string, findings string, "
    "impressions string, header string, in_hosp_mortality int, mortality_28d int"
)
SPLIT = "split string, scheme string, key string, subject_id long"

#: Ids of token types, and the words that start a code of each.
TYPE_IDS = {"special": 0, "diagnosis": 1, "lab": 2, "medication": 3, "procedure": 4, "transfer": 5, "icu": 6, "infusion": 7, "other": 8}
TYPE_PREFIXES = {"DIAGNOSIS": 1, "LAB": 2, "MEDICATION": 3, "PROCEDURE": 4, "TRANSFER_TO": 5, "ICU": 6, "INFUSION": 7}
#: Tokens of type special, whole.
SPECIAL_TOKENS = ["MEDS_BIRTH", "MEDS_DEATH", "[CLS]", "[PAD]", "[BOS]", "[EOS]"]
READMISSION_TOKENS = ["[W_0]", "[W_1]", "[W_2]", "[W_3]", "[M_1]"]
MISSING, DEFAULT_AGE, HOURS_PER_YEAR = -1, 25, 8766.0


def fields(ddl: str) -> dict[str, str]:
    """Names and types of a schema, in order."""
    return {f.name: f.dataType.simpleString() for f in T._parse_datatype_string(ddl).fields}


def conform(df: DataFrame, schema: str) -> DataFrame:
    """The schema's columns in its order: cast where castable, else null; null columns where absent."""
    have = {c.lower(): c for c in df.columns}
    out = []
    for f in T._parse_datatype_string(schema).fields:
        c = F.col(f"`{have[f.name.lower()]}`") if f.name.lower() in have else F.lit(None)
        out.append((c.try_cast(f.dataType) if f.name.lower() in have else c.cast(f.dataType)).alias(f.name))
    return df.select(*out)


def require(df: DataFrame, *groups: str | list[str]) -> DataFrame:
    """Raises unless df has every column; of a list, one of it."""
    for g in groups:
        names = [g] if isinstance(g, str) else g
        if not set(names) & set(df.columns):
            raise ValueError(f"missing column: {' or '.join(names)}; there are {', '.join(df.columns)}")
    return df
