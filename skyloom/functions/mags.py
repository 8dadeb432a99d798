"""Magnitude scales and notations as SQL expressions; an unknown magnitude is NULL."""

from __future__ import annotations

#: Declination zones (absolute degrees) of the five printed volumes.
VOLUMES = ((22, 31), (32, 41), (42, 51), (52, 61), (62, 90))


def volume(zone: str) -> str:
    """The volume of a zone, 1 to 5; NULL outside."""
    return "CASE " + " ".join(f"WHEN {zone} BETWEEN {a} AND {b} THEN {i}" for i, (a, b) in enumerate(VOLUMES, 1)) + " END"


def scale(mag: str, zone: str, table: dict[int, tuple[float, float, float]]) -> str:
    """a + b m + c m^2 with the coefficients of the zone's volume; NULL outside."""
    return "CASE " + " ".join(f"WHEN {zone} BETWEEN {VOLUMES[v - 1][0]} AND {VOLUMES[v - 1][1]} THEN {a!r}D + {b!r}D * {mag} + {c!r}D * {mag} * {mag}" for v, (a, b, c) in sorted(table.items())) + " END"


#: Published fits a + b m + c m^2 by volume (V to CD, CD to V), BD's in place of CD's elsewhere, and GC to V, which is the same up to a magnitude.
V_TO_CD = {1: (-0.157169, 1.188316, -0.022130), 2: (-1.517044, 1.595675, -0.050674), 3: (-4.903298, 2.435433, -0.098302), 4: (-1.347719, 1.513742, -0.040125), 5: (-4.814060, 2.342925, -0.087990)}
V_TO_BD = (0.441147, 1.699235, -0.079943)
CD_TO_V = {1: (-8.955, 3.221, -0.132), 2: (-4.874, 2.084, -0.055), 3: (-1.302, 1.163, 0.0), 4: (-5.647, 2.384, -0.083), 5: (0.154, 0.981, 0.0)}
GC_TO_V, GC_SAME = (-5.003, 2.305, -0.085), 3.0


def _quadratic(mag: str, k: tuple[float, float, float]) -> str:
    return f"({k[0]!r}D + {k[1]!r}D * {mag} + {k[2]!r}D * {mag} * {mag})"


def v_to_cd(mag: str, decl: str) -> str:
    """Johnson V on the scale of the volume that has the declination (degrees, south negative); BD's scale elsewhere."""
    return f"coalesce({scale(mag, f'-({decl})', V_TO_CD)}, {_quadratic(mag, V_TO_BD)})"


def cd_to_v(mag: str, decl: str) -> str:
    """A volume's magnitude as Johnson V; NULL outside the volumes."""
    return scale(mag, f"-({decl})", CD_TO_V)


def gc_to_v(mag: str) -> str:
    return f"CASE WHEN {mag} <= {GC_SAME!r}D THEN {mag} ELSE {_quadratic(mag, GC_TO_V)} END"


def visual(bt: str, vt: str) -> str:
    """V from the two photometric bands; one band alone is taken as it is."""
    return f"CASE WHEN {bt} <> 0 AND {vt} <> 0 THEN {vt} - 0.090D * ({bt} - {vt}) WHEN {vt} <> 0 THEN {vt} ELSE nullif({bt}, 0) END"


def two_integers(first: str, second: str, up: float, down: float) -> str:
    """'8 9' is a bit fainter than 8, '9 8' a bit brighter than 9; NULL for other pairs, which deserve a warning."""
    return f"CASE WHEN {second} = 0 OR {second} IS NULL THEN cast({first} AS double) WHEN {second} = {first} + 1 THEN {first} + {up!r}D WHEN {second} = {first} - 1 THEN {first} - {down!r}D END"


def int_half(whole: str, half: str) -> str:
    """An integer, and a half if the mark says 5."""
    return f"{whole} + CASE WHEN {half} = '5' THEN 0.5D ELSE 0.0D END"


def tenths(text: str) -> str:
    """Three digits are tenths, two are whole; V (variable) is NULL."""
    return f"CASE WHEN {text} LIKE '%V%' THEN NULL WHEN length(trim({text})) = 3 THEN cast(trim({text}) AS double) / 10 WHEN length(trim({text})) BETWEEN 1 AND 2 THEN cast(trim({text}) AS double) END"


#: The two notations of fractions, of the printed catalogue and of its scans.
CATALOGUE_FRACTIONS = {"1/4": 0.2, "1/2": 0.5, "3/4": 0.8}
SCAN_FRACTIONS = {"1/4": 0.2, "1/2": 0.5, "3/4": 0.7}


def fraction(whole: str, mark: str, table: dict[str, float]) -> str:
    return f"{whole} + CASE {mark} " + " ".join(f"WHEN '{k}' THEN {v!r}D" for k, v in table.items()) + " ELSE 0.0D END"


def instrumental(flux: str) -> str:
    """The magnitude of a flux, which counts as 100 at least."""
    return f"17.37D - 2.5D * log10(greatest({flux}, 100.0D))"
