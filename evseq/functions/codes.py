"""Functions on codes and tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evseq import schema


def col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)


def sanitize(code, preserve_bracketed: bool = False) -> Column:
    """Only ASCII letters, digits and _ stay. Brackets of special tokens may be kept: tokens then match the cohort functions."""
    c = col(code)
    clean = F.regexp_replace(c, "[^A-Za-z0-9_]", "")
    return F.when(c.rlike(r"^\[.*\]$"), c).otherwise(clean) if preserve_bracketed else clean


def sanitize_stay(code) -> Column:
    """Letters and digits of any script and _ stay; null is empty."""
    return F.regexp_replace(F.coalesce(col(code), F.lit("")), r"[^\p{L}\p{N}_]", "")


def token_type(code) -> Column:
    c = col(code)
    out = F.when(c.isin(schema.SPECIAL_TOKENS), schema.TYPE_IDS["special"])
    for prefix, i in schema.TYPE_PREFIXES.items():
        out = out.when(c.startswith(prefix), i)
    return out.otherwise(schema.TYPE_IDS["other"])


#: Fixed patterns. Death has two variants that differ in case; sepsis differs between tokens and raw codes.
DEATH = r"^MEDS_DEATH$|DEATH|deceased"
DEATH_ANY_CASE = r"^MEDS_DEATH$|DEATH|(?i:deceased)"
SEPSIS_TOKEN = r"^DIAGNOSIS(038|A40|A41)"
SEPSIS_CODE = r"(?i)^(DIAGNOSIS//)?(038|A40|A41)"


def is_death(token: Column, any_case: bool = False) -> Column:
    return token.rlike(DEATH_ANY_CASE if any_case else DEATH)


def is_sepsis_token(token: Column) -> Column:
    """Of tokens, sanitised or not."""
    return F.regexp_replace(F.upper(token), "[^A-Z0-9_]", "").rlike(SEPSIS_TOKEN)


def is_sepsis_code(code: Column) -> Column:
    return code.rlike(SEPSIS_CODE)


def truthy(c, extra: tuple[str, ...] = ()) -> Column:
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("true", "1", "yes", "y", *extra), F.lit(False))


def joined(tokens) -> Column:
    return F.array_join(col(tokens), " ")


def decode_label(token, labels: Column) -> Column:
    """The label of a token from a map; of a token that ends in _ and a digit, the label of what stands before and the ending."""
    t = col(token)
    base, suffix = F.regexp_extract(t, r"^(.*?)(_\d)$", 1), F.regexp_extract(t, r"^(.*?)(_\d)$", 2)
    of = lambda x: F.try_element_at(labels, x)
    return F.coalesce(F.when(suffix != "", F.concat(of(base), suffix)), of(t), t)


def strip_label(name) -> Column:
    return F.regexp_replace(col(name), "^label_", "")


def key_values(text) -> Column:
    """'a=0.5, b=0.5' as a map; of a key that stands twice the last value, what is no number as null. A part without `=` is an error, parts
    of white space alone are passed over; a null text is a null map."""
    parts = F.filter(F.split(col(text), ","), lambda x: F.trim(x) != "")
    key = lambda x: F.trim(F.split_part(x, F.lit("="), F.lit(1)))
    value = lambda x: F.trim(F.split_part(x, F.lit("="), F.lit(2))).try_cast("double")
    checked = F.transform(parts, lambda x: F.when(F.contains(x, F.lit("=")), F.struct(key(x).alias("k"), value(x).alias("v"))).otherwise(F.raise_error(F.concat(F.lit("no = in "), x)).cast("struct<k:string,v:double>")))
    last = F.filter(checked, lambda x, i: ~F.exists(F.slice(checked, i + 2, F.size(checked)), lambda z: z["k"] == x["k"]))
    return F.map_from_entries(last)


def one_word(token) -> Column:
    """The token; an error if it holds a space."""
    t = col(token)
    return F.when(t.contains(" "), F.raise_error(F.concat(F.lit("token with a space: "), t)).cast("string")).otherwise(t)


def resolve_path(path, root: str) -> Column:
    p = col(path)
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))


def image_path(subject, study, dicom) -> Column:
    s = col(subject).cast("string")
    return F.concat(F.lit("p"), F.substring(s, 1, 2), F.lit("/p"), s, F.lit("/s"), col(study).cast("string"), F.lit("/"), col(dicom), F.lit(".jpg"))


def preferred_path(tensor, jpg) -> Column:
    """The tensor's path if there is one, else the image's; null if neither: such rows are dropped by the caller."""
    real = lambda c: F.when(F.trim(col(c)) != "", col(c))
    return F.coalesce(real(tensor), real(jpg))
