"""Labels and rules read off archive and member names, as one CASE expression each."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.config import IMU, SENSORS

#: Protocol rules in order of precedence. A rule holds if the lower-case member contains one of its needles
#: (or starts with one marked ^): fault offset (s), baseline, its seconds, confidence.
PROTOCOLS = [
    (("experiment_a1", "^8-3-26 run/"), (300.0, "pre_fault", 300.0, "protocol")),
    (("experiment_a3",), (300.0, "pre_fault", 300.0, "protocol")),
    (("experiment_a2",), (0.0, "tail_recovery", 300.0, "protocol")),
    (("loose connector", "partial-occlusion"), (300.0, "pre_fault", 300.0, "protocol_family")),
    (("supply-voltage-droop",), (0.0, "initial_proxy", 60.0, "limited")),
    (("imu bias injection",), (0.0, "initial_proxy", 60.0, "limited")),
    (("accelerated aging",), (0.0, "initial_proxy", 60.0, "limited")),
]
DEFAULT_PROTOCOL = (300.0, "pre_fault", 300.0, "assumed")
#: Families by needles in the archive's name, now and in the older metrics.
FAMILIES = [(("a1", "shaker"), "A1_orbital_shaker"), (("a2", "thermal", "fridge"), "A2_thermal_fridge"), (("a3", "emi"), "A3_smartphone_emi"), (("faulty_hardware", "experiment_b"), "B_faulty_hardware")]
LEGACY_FAMILIES = [(("a1", "shaker"), "A1_orbital_shaker"), (("a2", "thermal", "fridge"), "A2_thermal"), (("a3", "emi"), "A3_emi"), (("faulty_hardware", "_b_"), "B_faulty_hardware")]
SUBTYPES = [(("loose connector",), "loose_connector"), (("imu bias injection",), "imu_bias_injection"), (("partial-occlusion", "partial occlusion"), "partial_occlusion"), (("accelerated aging",), "accelerated_aging"), (("supply-voltage-droop", "supply voltage droop"), "supply_voltage_droop")]
LEGACY_SUBTYPES = [(("loose connector",), "loose_connector"), (("imu bias injection",), "imu_bias"), (("partial-occlusion",), "partial_occlusion"), (("accelerated aging",), "accelerated_aging"), (("supply-voltage-droop",), "supply_voltage_droop")]
FAMILY_SUBTYPES = {"A1_orbital_shaker": "orbital_shaker", "A2_thermal_fridge": "thermal_fridge", "A3_smartphone_emi": "smartphone_emi"}


def _holds(lower: Column, needles: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(lower, F.lit(n[1:])) if n[0] == "^" else F.contains(lower, F.lit(n)) for n in needles])


def _case(rules: list, otherwise: Column) -> Column:
    first, *rest = rules
    out = F.when(*first)
    for condition, value in rest:
        out = out.when(condition, value)
    return out.otherwise(otherwise)


def protocol(member: Column, override: Column | None = None) -> Column:
    """Struct fault_offset_s, baseline, baseline_seconds, confidence; an override in seconds takes precedence."""
    override = F.lit(None).cast("double") if override is None else override
    make = lambda a, b, c, d: F.struct(a.cast("double").alias("fault_offset_s"), b.alias("baseline"), c.cast("double").alias("baseline_seconds"), d.alias("confidence"))
    fixed = lambda v: make(*[F.lit(x) for x in v])
    manual = make(override, F.when(override > 0, F.lit("pre_fault")).otherwise(F.lit("initial_proxy")), F.when(override > 0, override).otherwise(F.lit(60.0)), F.lit("manual"))
    rules = [(override.isNotNull(), manual)] + [(_holds(F.lower(member), needles), fixed(v)) for needles, v in PROTOCOLS]
    return _case(rules, fixed(DEFAULT_PROTOCOL))


def family(archive: Column, legacy: bool = False) -> Column:
    rules = LEGACY_FAMILIES if legacy else FAMILIES
    return _case([(_holds(F.lower(archive), n), F.lit(label)) for n, label in rules], F.lit("other" if legacy else "unclassified"))


def subtype(member: Column, of_family: Column | None = None, legacy: bool = False) -> Column:
    """By the member's path; without a match by the family, or empty in the older metrics."""
    rules = [(_holds(F.lower(member), n), F.lit(label)) for n, label in (LEGACY_SUBTYPES if legacy else SUBTYPES)]
    if legacy:
        return _case(rules, F.lit(""))
    rules += [(of_family == f, F.lit(s)) for f, s in FAMILY_SUBTYPES.items()]
    return _case(rules, F.lit("unclassified"))


def target(member: Column, of_family: Column) -> Column:
    """In the faulty-hardware family, the path part after the one that names the fault; else empty."""
    parts = F.transform(F.split(F.replace(member, F.lit("\\"), F.lit("/")), "/"), lambda p: F.trim(p))
    needles = F.array(*[F.lit(n) for ns, _ in SUBTYPES for n in ns])
    pairs = F.zip_with(F.slice(parts, F.lit(1), F.size(parts) - 1), F.slice(parts, F.lit(2), F.size(parts) - 1), lambda a, b: F.when(F.array_contains(needles, F.lower(a)), b))
    return F.when(of_family == "B_faulty_hardware", F.coalesce(F.get(F.filter(pairs, lambda x: x.isNotNull()), 0), F.lit(""))).otherwise(F.lit(""))


def is_target(target_name: Column, sensor: Column) -> Column:
    t, s = F.trim(F.lower(target_name)), F.trim(F.lower(sensor))
    return F.when(t == "", F.lit(False)).when(t == "imu", s.isin(*IMU)).otherwise(t == s)


def member_sensor(member: Column) -> Column:
    """The sensor a CSV member holds, null if it is none of the known ones."""
    name = F.regexp_extract(F.lower(member), r"([^/]*)\.csv$", 1)
    name = F.regexp_replace(name, "^proc_", "")
    return F.when(name.isin(*SENSORS), name)


def valid_member(member: Column) -> Column:
    """A converted CSV of a known sensor, outside hidden and system folders."""
    parts = F.filter(F.split(F.lower(member), "/"), lambda p: p != "")
    hidden = F.exists(parts, lambda p: p.startswith(".") | (p == "__macosx"))
    return F.coalesce(member_sensor(member).isNotNull() & F.array_contains(parts, "converted") & ~hidden, F.lit(False))


def safe_component(name: Column) -> Column:
    """Letters, digits, - _ . kept, all else an underscore; no dots or underscores at the ends; never empty."""
    kept = F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9._-]", "_"), "^[._]+|[._]+$", "")
    return F.when(kept == "", F.lit("item")).otherwise(kept)


def job_id(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts, joined by NUL."""
    return F.substring(F.sha2(F.concat_ws("\0", *parts), 256), 1, 16)


def calibration_bounds(first: Column, last: Column, p: Column) -> Column:
    """Struct start, end (half open) of the calibration interval in ms, and fault_start."""
    span = F.bround(p["baseline_seconds"] * 1000).cast("long")
    fault = first + F.bround(p["fault_offset_s"] * 1000).cast("long")
    start = F.when(p["baseline"] == "tail_recovery", F.greatest(first, last - span)).otherwise(first)
    end = F.when(p["baseline"] == "tail_recovery", last + 1).when(p["baseline"] == "pre_fault", F.least(last + 1, fault)).otherwise(F.least(last + 1, first + span))
    return F.struct(start.alias("start"), end.alias("end"), fault.alias("fault_start"))


def in_baseline(ts: Column, first: Column, last: Column, p: Column) -> Column:
    """The reliability score's own rule: closed bounds, truncated seconds, no look at the onset."""
    span = (p["baseline_seconds"] * 1000).cast("long")
    return F.when(p["baseline"] == "tail_recovery", ts >= last - span).otherwise(ts <= first + span)
