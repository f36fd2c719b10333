"""Quantities recorded in different units to one common unit per item, in pure SQL expressions.

A number and a unit are taken out of the text with regular expressions; the unit is the
first found of unit field, text and label; aliases and conversion factors come in by joins
with small fixed tables. A number without any unit stays on the common scale if the item
can have that value there; otherwise it is read on another scale of the item on which it
is possible, ties going to the unit its source reports most often.

Defined results for odd input: an item or unit that is unknown, a null number, a word or a
bound (<, >) gives a null common value and is no conversion; doses counted in pieces
(tablets, puffs, bags) likewise; a range counts as its midpoint; duplicate rows each keep
their row; an empty table gives an empty table; extra columns pass through untouched, but
one named like a column that is added gives way to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.columns import shielded
from chartloom.session import broadcast_checked

# Spellings of units after lower-casing and dropping blanks and dots.
ALIASES = {
    "bpm": "bpm beats/min /min beatsperminute",
    "insp/min": "insp/min breaths/min br/min /min",
    "mmHg": "mmhg mm[hg]",
    "kPa": "kpa",
    "degC": "degc c °c celsius",
    "degF": "degf f °f fahrenheit",
    "%": "% pct percent",
    "fraction": "fraction ratio",
    "kg": "kg kgs kilogram kilograms",
    "lb": "lb lbs pound pounds",
    "g": "g gm gram grams",
    "mg": "mg mgs milligram milligrams",
    "mcg": "mcg ug microgram micrograms",
    "points": "points point /10",
    "mL": "ml cc milliliter millilitre milliliters millilitres",
    "L": "l litre liter litres liters",
    "mg/dL": "mg/dl",
    "mg/L": "mg/l",
    "g/dL": "g/dl gm/dl",
    "g/L": "g/l",
    "mmol/L": "mmol/l mm",
    "mEq/L": "meq/l",
    "umol/L": "umol/l mcmol/l micromol/l",
    "K/uL": "k/ul thou/ul x10^3/ul 10^3/ul x10^9/l 10^9/l x10e3/ul 10e9/l g/l",
    "/uL": "/ul perul /mm3 cells/ul",
    "UNIT": "unit units iu u",
    "kU": "ku thousandunits",
    "mEq": "meq",
    "mmol": "mmol",
    "pieces": "tab tabs tablet tablets cap caps capsule capsules puff puffs spry spray sprays bag bags patch patches",
}
# Item, unit, factor and offset to the item's common unit (value * factor + offset).
CONVERSIONS = [
    ("heart rate", "bpm", 1.0, 0.0), ("respiratory rate", "insp/min", 1.0, 0.0),
    ("systolic blood pressure", "mmHg", 1.0, 0.0), ("systolic blood pressure", "kPa", 7.50062, 0.0),
    ("diastolic blood pressure", "mmHg", 1.0, 0.0), ("diastolic blood pressure", "kPa", 7.50062, 0.0),
    ("body temperature", "degC", 1.0, 0.0), ("body temperature", "degF", 5.0 / 9.0, -160.0 / 9.0),
    ("oxygen saturation", "%", 1.0, 0.0), ("oxygen saturation", "fraction", 100.0, 0.0),
    ("body weight", "kg", 1.0, 0.0), ("body weight", "lb", 0.45359237, 0.0), ("body weight", "g", 0.001, 0.0),
    ("pain score", "points", 1.0, 0.0), ("urine output", "mL", 1.0, 0.0), ("urine output", "L", 1000.0, 0.0),
    ("glucose", "mg/dL", 1.0, 0.0), ("glucose", "mmol/L", 18.016, 0.0),
    ("creatinine", "mg/dL", 1.0, 0.0), ("creatinine", "umol/L", 1.0 / 88.42, 0.0),
    ("hemoglobin", "g/dL", 1.0, 0.0), ("hemoglobin", "g/L", 0.1, 0.0),
    ("potassium", "mmol/L", 1.0, 0.0), ("potassium", "mEq/L", 1.0, 0.0), ("potassium", "mg/dL", 1.0 / 3.91, 0.0),
    ("sodium", "mmol/L", 1.0, 0.0), ("sodium", "mEq/L", 1.0, 0.0), ("sodium", "mg/dL", 1.0 / 2.299, 0.0),
    ("bilirubin, total", "mg/dL", 1.0, 0.0), ("bilirubin, total", "umol/L", 1.0 / 17.1, 0.0),
    ("lactate", "mmol/L", 1.0, 0.0), ("lactate", "mg/dL", 1.0 / 9.008, 0.0),
    ("platelet count", "K/uL", 1.0, 0.0), ("platelet count", "/uL", 0.001, 0.0),
    ("calcium, total", "mg/dL", 1.0, 0.0), ("calcium, total", "mmol/L", 4.008, 0.0),
    ("c-reactive protein", "mg/L", 1.0, 0.0), ("c-reactive protein", "mg/dL", 10.0, 0.0),
]
# Sizes of dose units in milligrams, units and milliequivalents; item-specific ones last.
MASS = {"g": 1000.0, "mg": 1.0, "mcg": 0.001}
ACTIVITY = {"UNIT": 1.0, "kU": 1000.0}
CHARGE = {"mEq": 1.0, "mmol": 1.0}
DRUG_CONVERSIONS = [("cholecalciferol", "mcg", 40.0), ("cholecalciferol", "mg", 40000.0), ("magnesium sulfate", "mEq", 0.1232), ("potassium chloride", "mg", 1.0 / 74.55), ("potassium chloride", "g", 1000.0 / 74.55)]

REFERENCE_BOUND = 1000  # rows of the measure reference that may be turned into literals
OUTPUTS = ["q_item", "q_number", "q_unit", "q_unit_from", "q_value", "q_converted", "q_common_unit", "q_low", "q_high", "q_slack"]
HABIT_BOUND = 200_000  # pairs of item and source up to which their usual units are broadcast
_NUMBER = r"^\s*([-+]?\d[\d.,]*)\s*(?:(?:-|–|to)\s*(\d[\d.,]*)\s*)?(.*?)\s*$"


def _literal_rows(spark, rows: list[tuple], columns: str) -> DataFrame:
    def lit(v):
        return "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}D" if isinstance(v, float) else str(v)

    return spark.sql(f"SELECT * FROM VALUES {', '.join('(' + ', '.join(lit(v) for v in r) + ')' for r in rows)} AS t({columns})")


def reference_rows(reference: DataFrame) -> list:
    rows = reference.select("label", "kind", "common_unit", "possible_low", "possible_high").where("label IS NOT NULL").limit(REFERENCE_BOUND + 1).collect()
    if len(rows) > REFERENCE_BOUND:
        raise ValueError(f"the measure reference has more than {REFERENCE_BOUND} rows")
    return rows


def conversion_rows(reference: list) -> list[tuple]:
    """(item, unit, factor, offset) for every item of the reference, its own unit included."""
    out = {(i, u): (f, o) for i, u, f, o in CONVERSIONS}
    for r in reference:
        item = r.label.lower()
        out.setdefault((item, r.common_unit), (1.0, 0.0))
        if r.kind == "drug":
            for sizes in (MASS, ACTIVITY, CHARGE):
                if r.common_unit in sizes:
                    out |= {(item, u): (s / sizes[r.common_unit], 0.0) for u, s in sizes.items()}
            out |= {(i, u): (f, 0.0) for i, u, f in DRUG_CONVERSIONS if i == item and (i, u) not in out}
    return [(i, u, f, o) for (i, u), (f, o) in sorted(out.items())]


def alias_rows(conversions: list[tuple]) -> list[tuple]:
    """(item, spelling, unit): a spelling is read as a unit the item has."""
    units: dict[str, set[str]] = {}
    for i, u, _, _ in conversions:
        units.setdefault(i, set()).add(u)
    rows = []
    for item, own in sorted(units.items()):
        spelt: dict[str, str] = {}
        for unit, spellings in ALIASES.items():
            for s in spellings.split():
                if unit in own:
                    spelt.setdefault(s, unit)
        rows += [(item, s, u) for s, u in sorted(spelt.items())]
    return rows


def unit_key(c: Column) -> Column:
    """Lower case without blanks and dots, micro signs as u; null if nothing is left."""
    low = F.lower(c)
    for old, kept in ((" ", ""), (".", ""), ("\u00a0", ""), ("\u00b5", "u"), ("\u03bc", "u")):
        low = F.replace(low, F.lit(old), F.lit(kept))
    return F.nullif(F.when(low.rlike(r"\s"), F.regexp_replace(low, r"\s+", "")).otherwise(low), F.lit(""))


def _decimal(c: Column, thousands: bool) -> Column:
    plain = F.regexp_replace(c, ",", ".")
    grouped = F.when(c.rlike(r"^\d{1,3}(,\d{3})+(\.\d+)?$"), F.regexp_replace(c, ",", "")).otherwise(plain)
    return (grouped if thousands else plain).try_cast("double")


def item_of(name: Column, names: list[str]) -> Column:
    """The reference label a name is or begins with: looked up as it stands, then before a bracket, then by pattern."""
    key = F.lower(F.trim(name))
    known = F.create_map(*[F.lit(x) for n in names for x in (n, n)]) if names else F.create_map().cast("map<string,string>")
    quoted = "|".join("".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in n) for n in names)
    return F.coalesce(
        F.try_element_at(known, key),
        F.try_element_at(known, F.substring_index(key, " (", 1)),
        F.nullif(F.regexp_extract(key, rf"^({quoted})(?![a-z])", 1), F.lit("")),
    )


def parsed_quantities(events: DataFrame, names: list[str]) -> DataFrame:
    """Lab, vital and medication events with item, number, decimals and spelled unit.

    Plain digits, which most values are, never meet a regular expression.
    """
    dose = F.col("event_type") == "medication"
    name, text, field = (F.when(dose, F.col(a)).otherwise(F.col(b)) for a, b in (("drug", "label"), ("dose", "value"), ("dose_unit", "unit")))
    rows = events.where(F.col("event_type").isin("lab", "vital", "medication")).withColumns({"_name": name, "_raw": text})
    digits = (F.translate("_raw", "0123456789.", "") == "") & F.substring("_raw", 1, 1).between("0", "9")
    rows = rows.withColumn("_plain", F.coalesce(digits, F.lit(False)))
    first, second, rest = (F.regexp_extract("_raw", _NUMBER, i) for i in (1, 2, 3))
    low, high = (F.when(dose, _decimal(c, True)).otherwise(_decimal(c, False)) for c in (first, second))
    in_text = F.when(dose, F.coalesce((low + high) / 2, low)).otherwise(low)
    trimmed = F.trim("_raw")
    worded = F.coalesce((trimmed != "") & trimmed.rlike(r"^[^\d+-]|^[-+]?\D*$"), F.lit(False))
    number = F.when(F.col("_plain"), F.when(dose, F.col("_raw").try_cast("double")).otherwise(F.coalesce(F.col("valuenum"), F.col("_raw").try_cast("double"))))
    number = number.when(worded, None).when(dose, in_text).otherwise(F.coalesce(F.col("valuenum"), in_text))
    point = F.instr("_raw", ".")
    decimals = F.when(F.col("_plain"), F.when(point > 0, F.length("_raw") - point).otherwise(0)).otherwise(F.length(F.regexp_extract(first, r"[.,](\d+)$", 1)))
    bracket = F.when(F.contains("_name", F.lit("(")), F.regexp_extract("_name", r"\(([^()]*)\)\s*$", 1))
    rows = rows.withColumns({"q_item": item_of(F.col("_name"), names), "_number": number, "_digits": decimals, "_field": unit_key(field), "_text": unit_key(F.when(~F.col("_plain"), rest)), "_label": unit_key(bracket)})
    source = F.when(F.col("_field").isNotNull(), "field").when(F.col("_text").isNotNull(), "text").when(F.col("_label").isNotNull(), "label").otherwise("scale")
    return rows.withColumns({"_spelt": F.coalesce("_field", "_text", "_label"), "_from": source}).drop("_name", "_raw", "_plain", "_field", "_text", "_label")


def normalise_quantities(events: DataFrame, reference: DataFrame) -> DataFrame:
    """Lab, vital and medication events with, besides their own columns,

    q_item (lower-case reference label), q_number, q_unit, q_unit_from (field, text, label,
    scale), q_value (number in the common unit, null if there is none), q_converted (recorded
    on another unit or scale), q_low, q_high (possible range), q_slack (rounding of the unit).
    """
    spark = events.sparkSession
    events, kept = shielded(events, lambda c: c.startswith("_"), OUTPUTS)
    ref = reference_rows(reference)
    conversions = conversion_rows(ref)
    names = sorted({r.label.lower() for r in ref}, key=lambda x: (-len(x), x))
    rows = parsed_quantities(events, names)
    # One row per item, with the other scales for numbers that come without a unit.
    items = _literal_rows(spark, [(r.label.lower(), r.common_unit, r.possible_low, r.possible_high) for r in ref], "q_item, q_common_unit, q_low, q_high")
    scales = _literal_rows(spark, conversions, "q_item, _unit, _factor, _offset")
    other_scales = scales.where("_factor <> 1 OR _offset <> 0").groupBy("q_item").agg(F.sort_array(F.collect_list(F.struct("_unit", "_factor", "_offset"))).alias("_scales"))
    items = items.select("q_item", "q_common_unit", F.col("q_low").cast("double"), F.col("q_high").cast("double")).join(other_scales, "q_item", "left")
    aliases = _literal_rows(spark, alias_rows(conversions), "q_item, _spelt, _unit").join(scales, ["q_item", "_unit"])
    joined = rows.join(F.broadcast(items), "q_item", "left").join(F.broadcast(aliases), ["q_item", "_spelt"], "left")
    scaled = F.col("_number").isNotNull() & F.col("_spelt").isNull() & F.col("q_low").isNotNull() & ~F.col("_number").between(F.col("q_low"), F.col("q_high"))
    joined = joined.withColumn("_guess", F.when(scaled, F.expr("filter(_scales, s -> _number * s._factor + s._offset BETWEEN q_low AND q_high)")))
    ranged = {r.label.lower() for r in ref if r.possible_low is not None}
    unclear = sorted(i for i in ranged if sum(c[0] == i and (c[2] != 1 or c[3] != 0) for c in conversions) > 1)
    if unclear:  # only these items can fit on more than one scale, so only their rows are counted
        begins = F.greatest(*[F.startswith(F.lower(F.trim("label")), F.lit(i)) for i in [*unclear, unclear[0]]])
        habit = source_units(parsed_quantities(events.where(F.col("event_type").isin("lab", "vital") & begins), names).where(F.col("q_item").isin(*unclear)), aliases)
        joined = joined.join(broadcast_checked(habit, "unit-habits", HABIT_BOUND), ["q_item", "source"], "left")
    else:
        joined = joined.withColumn("_habit", F.lit(None).cast("string"))
    joined = joined.withColumn("_pick", F.expr("CASE WHEN size(_guess) > 1 THEN coalesce(get(filter(_guess, s -> s._unit = _habit), 0), get(_guess, 0)) WHEN size(_guess) = 1 THEN get(_guess, 0) END"))
    bare = F.col("_spelt").isNull()
    joined = joined.withColumns(
        {
            "q_unit": F.when(bare, F.coalesce("_pick._unit", "q_common_unit")).otherwise(F.col("_unit")),
            "_by": F.when(bare, F.coalesce("_pick._factor", F.when(F.col("q_common_unit").isNotNull(), 1.0))).otherwise(F.col("_factor")),
            "_plus": F.when(bare, F.coalesce("_pick._offset", F.lit(0.0))).otherwise(F.col("_offset")),
        }
    )
    other = (F.col("_by") != 1) | (F.col("_plus") != 0)
    return joined.select(
        *kept,
        "q_item",
        F.col("_number").alias("q_number"),
        "q_unit",
        F.col("_from").alias("q_unit_from"),
        (F.col("_number") * F.col("_by") + F.col("_plus")).alias("q_value"),
        F.coalesce(F.col("_number").isNotNull() & other, F.lit(False)).alias("q_converted"),
        "q_common_unit",
        "q_low",
        "q_high",
        F.when(other, F.abs(F.col("_by")) * F.pow(F.lit(10.0), -F.coalesce("_digits", F.lit(0))) * 0.51).otherwise(0.0).alias("q_slack"),
    )


def source_units(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """The unit each source reports most often for an item: few rows, pre-aggregated on the map side."""
    counted = rows.where("_spelt IS NOT NULL").join(F.broadcast(aliases.select("q_item", "_spelt", "_unit")), ["q_item", "_spelt"]).groupBy("q_item", "source", F.col("_unit").alias("_habit")).count()
    return counted.groupBy("q_item", "source").agg(F.max_by("_habit", F.struct("count", "_habit")).alias("_habit"))


def converted_events(events: DataFrame, reference: DataFrame) -> DataFrame:
    """Ids of events whose number is on another unit or scale than the common one."""
    return normalise_quantities(events, reference).where("q_converted").select(F.col("event_id").cast("bigint").alias("event_id")).distinct()
