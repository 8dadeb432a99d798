"""Drawing rules of charts as columns: sizes, labels, notes and the field of view around a boundary."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Plates (size 0 at this magnitude, points a magnitude, least size), charts (faintest size, points a magnitude, least size).
PLATE, CHART = (6.2, 2.2, 0.6), (10.0, 2.0, 2.0)
#: Magnitudes this near 0 are unknown and drawn as STAND_IN; fainter stars than LABELLED have no label; degrees around a boundary.
UNKNOWN, STAND_IN, LABELLED, PAD = 1e-6, 9.0, 7.0, 5.0
#: Variable-star fields that say nothing.
SILENT = ("", "Var", "Var?")


def size(mag: Column, rule: tuple[float, float, float] = PLATE) -> Column:
    faintest, slope, least = rule
    return F.greatest(F.lit(least), (faintest - mag) * slope)


def known(mag: Column) -> Column:
    """The magnitude to draw: STAND_IN where it is unknown."""
    return F.when(F.abs(mag) < UNKNOWN, STAND_IN).otherwise(mag)


def label(name: Column, mag: Column, mode: str) -> Column:
    """``mag`` (tenths), ``full`` (the name) or ``number`` (digits at the name's end, else the name); NULL for faint or unknown ones."""
    if mode == "mag":
        return F.when(known(mag) <= LABELLED, F.bround(known(mag) * 10).cast("int").cast("string"))
    tail = F.regexp_extract(name, r"([0-9]+)$", 1)
    text = {"full": name, "number": F.when(tail != "", tail).otherwise(name)}[mode]
    return F.when((F.abs(mag) >= UNKNOWN) & (mag <= LABELLED), text)


def variable_note(field: Column) -> Column:
    """A note for a variable star's designation; empty for bare numbers and for what says nothing."""
    silent = field.isNull() | field.isin(*SILENT) | field.rlike("^[0-9]+$")
    return F.when(silent, "").otherwise(F.concat(F.lit("Var: "), field))


def field_of_view(ra_lo: Column, ra_hi: Column, dec_lo: Column, dec_hi: Column) -> Column:
    """A struct of limits and centre: a whole polar cap where the boundary holds a pole or goes around one, else the padded box."""
    round_ = (ra_hi - ra_lo) > 350.0
    south = (dec_lo <= -89.5) | (round_ & (dec_hi < 0))
    north = ~south & ((dec_hi >= 89.5) | (round_ & (dec_lo > 0)))
    cap = south | north
    low, high = F.greatest(F.lit(-90.0), dec_lo - PAD), F.least(F.lit(90.0), dec_hi + PAD)
    return F.struct(
        F.when(cap, 0.0).otherwise(ra_lo - PAD).alias("ra_min"), F.when(cap, 360.0).otherwise(ra_hi + PAD).alias("ra_max"),
        F.when(south, -90.0).otherwise(low).alias("dec_min"), F.when(north, 90.0).otherwise(high).alias("dec_max"),
        F.when(cap, 0.0).otherwise((ra_lo + ra_hi) / 2).alias("center_ra"), F.when(south, -90.0).when(north, 90.0).otherwise((dec_lo + dec_hi) / 2).alias("center_dec"),
    )
