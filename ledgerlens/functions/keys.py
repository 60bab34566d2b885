"""Entity keys as normalised text; missing keys are NULL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that stand for a missing key.
MISSING_TEXTS = ("", "nan", "none")

# Device descriptions too generic to identify a device. A default of this package.
GENERIC_DEVICES = ("unknown", "other", "n/a")


def clean_key(key: Column) -> Column:
    """Key as trimmed text, whole numbers without decimals or exponent, missing values as NULL."""
    text = trimmed = F.trim(key.cast("string"))
    # Doubles from 10^7 on print with an exponent, whole numbers of other types do not.
    plain = F.regexp_replace(text.try_cast("decimal(38,10)").cast("string"), r"(\.[0-9]*?)0+$", "$1")
    text = F.when(text.rlike(r"^-?[0-9]\.[0-9]+E[0-9]+$"), F.coalesce(F.regexp_replace(plain, r"\.$", ""), text)).otherwise(text)
    whole = F.regexp_replace(text, r"^(-?[0-9]+)\.0+$", "$1")
    # Most keys have no decimals, and then no pattern has anything to do.
    whole = F.when(trimmed.contains("."), whole).otherwise(trimmed)
    return F.when(~F.lower(trimmed).isin(*MISSING_TEXTS), whole)


def clean_device(device: Column, generic: Sequence[str] = GENERIC_DEVICES) -> Column:
    """Device text in lower case, NULL when blank or generic."""
    text = F.lower(F.trim(device.cast("string")))
    return F.when(~text.isin(*MISSING_TEXTS, *generic), text)
