"""Column functions for labels, families and text keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that name a test session at the front of a label, and a state or setting at its end.
PREFIX_WORDS = ("test", "tmp", "temp", "demo", "trial", "probe", "check")
STATE_WORDS = (
    "on off run running standby idle only trig low med medium high min max rotation rotate rotating no swing withswing "
    "mix mixed directoff small delay slow fast test again new"
).split()
#: Level words, with or without a number.
LEVEL = "(?:lvl|level|stufe|speed|st)[0-9]*"


def strip_timestamp(label: Column) -> Column:
    """Without a trailing ``_YYYYmmdd_HHMMSS``."""
    return F.regexp_replace(label, "_\\d{8}_\\d{6}$", "")


def family(label: Column) -> Column:
    """The device family: session words in front and states, levels and numbers behind are cut; one token always stays."""
    plain = F.regexp_replace(F.regexp_replace(strip_timestamp(F.lower(F.trim(F.coalesce(label, F.lit(""))))), "_+", "_"), "^_|_$", "")
    front = F.regexp_replace(plain, f"^(?:(?:{'|'.join(PREFIX_WORDS)})_)+(?=.)", "")
    back = F.regexp_replace(front, f"(?:_(?:{'|'.join(STATE_WORDS)}|{LEVEL}|[0-9]+))+$", "")
    return F.coalesce(F.nullif(back, F.lit("")), F.lit("appliance"))


def families(label: Column) -> Column:
    """Families of a mixed label, in order and without repeats."""
    return F.array_distinct(F.transform(F.split(strip_timestamp(F.lower(F.trim(label))), "__"), family))


def is_mixed(label: Column) -> Column:
    return strip_timestamp(label).contains("__")


def without_instance(name: Column) -> Column:
    """Cut at the last underscore."""
    return F.regexp_replace(name, "_[^_]*$", "")


def djb2(text: Column) -> Column:
    """32-bit djb2 over the characters' code points."""
    return F.aggregate(F.filter(F.split(text, ""), lambda x: x != ""), F.lit(5381).cast("long"), lambda h, c: (h * 33 + F.ascii(c)).bitwiseAND(F.lit((1 << 32) - 1)))


def safe_label(label: Column) -> Column:
    """Lower case, runs outside ``[a-z0-9_-]`` as one underscore, none at the ends, ``appliance`` if nothing is left."""
    cut = F.regexp_replace(F.regexp_replace(F.lower(label), "[^a-z0-9_-]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(cut, F.lit("")), F.lit("appliance"))


def label_of(label: Column, metadata: Column) -> Column:
    """The label itself, else the name in the JSON metadata, else ``unknown``."""
    return F.coalesce(F.nullif(label, F.lit("")), F.nullif(F.get_json_object(metadata, "$.name"), F.lit("")), F.lit("unknown"))


def is_on(power: Column, threshold: float = 3.0) -> Column:
    """``on`` where the magnitude exceeds the threshold, else ``off``."""
    return F.when(F.abs(power) > threshold, "on").otherwise("off")
