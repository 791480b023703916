"""Domain formulas as column expressions (DOM-1 to DOM-15, BIN-1 to BIN-3, PRJ-6, PRJ-17 to PRJ-20)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewheel.functions.calendar import days_in_month
from tidewheel.functions.nulls import is_true, ratio

#: Polynomial of the turbine's power in kW by wind speed in m/s, lowest power first.
POWER_CURVE = (634.228, -1248.5, 999.57, -426.224, 105.617, -15.4587, 1.3223, -0.0609186, 0.00116265)
BASE_KELVIN = 293.45


def wrap_longitude(lon: Column) -> Column:
    """DOM-1: into [-180, 180)."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def cooling_degree(kelvin: Column, base: float = BASE_KELVIN, keep_null: bool = False) -> Column:
    """DOM-2: degrees above the base. A missing temperature counts as 0 unless keep_null."""
    value = F.when(kelvin > base, kelvin - base).otherwise(0.0)
    return F.when(kelvin.isNotNull(), value) if keep_null else value


def heating_degree(kelvin: Column, base: float = BASE_KELVIN, keep_null: bool = False) -> Column:
    """DOM-3: degrees below the base."""
    value = F.when(kelvin < base, base - kelvin).otherwise(0.0)
    return F.when(kelvin.isNotNull(), value) if keep_null else value


def wind_speed(u: Column, v: Column) -> Column:
    """DOM-4."""
    return F.sqrt(u * u + v * v)


def hub_height_speed(speed: Column, low: float = 10.0, high: float = 100.0, exponent: float = 0.14) -> Column:
    """DOM-5: power law from one height to another."""
    return speed * (high / low) ** exponent


def wind_power(speed: Column, zero_outside: bool = False) -> Column:
    """DOM-6: kW of a 2 MW turbine. Below 3 and above 25 m/s the speed counts as 0, where the polynomial gives
    634.228; zero_outside gives no power there instead."""
    outside = (speed < 3) | (speed > 25)
    s = F.when(outside, 0.0).when(speed > 12.5, 12.5).otherwise(speed)
    power = F.lit(POWER_CURVE[-1])
    for c in POWER_CURVE[-2::-1]:
        power = power * s + c
    return F.when(outside, 0.0).otherwise(power) if zero_outside else power


def wind_capacity_factor(speed: Column, zero_outside: bool = False) -> Column:
    """DOM-7."""
    return wind_power(speed, zero_outside) / 1000 / 2


def solar_capacity_factor(radiation: Column) -> Column:
    """DOM-8: from J/m2 a day."""
    return radiation / (1000 * 86400) * 0.9 * 0.95


def hydraulic_power(flow: Column, head: Column) -> Column:
    """DOM-11: MW for features."""
    return flow * head * 9.81 / 1000


def potential_power(flow: Column, head: Column) -> Column:
    """DOM-12: MW for matching, with another water density."""
    return flow * head * 997 * 9.81 / 1e6


def cell_area(lat: Column, half_lat: float, width: float) -> Column:
    """DOM-9: km2 of a longitude-latitude cell on the WGS84 ellipsoid, in closed form (edges along parallels).

    A polygon with geodesic edges differs by under 1e-5 for cells of a tenth of a degree up to latitude 60.
    """
    a, f = 6378.137, 1 / 298.257223563
    e = math.sqrt(f * (2 - f))
    b2 = (a * (1 - f)) ** 2

    def zone(degrees: Column) -> Column:
        s = F.sin(F.radians(degrees))
        return s / (1 - (e * s) * (e * s)) + F.log((1 + e * s) / (1 - e * s)) / (2 * e)

    return F.lit(b2 * math.radians(width) / 2) * (zone(lat + half_lat) - zone(lat - half_lat))


def mean_power_mw(value: Column, unit: Column, month: Column) -> Column:
    """PRJ-6: MWH and GWH or MU of a month as mean MW; any other unit as it is."""
    hours = days_in_month(month) * 24
    return F.when(unit == "MWH", value / hours).when(unit.isin("GWH", "MU"), value * 1000 / hours).otherwise(value)


def month_energy(capacity_factor: Column, capacity: Column, month: Column) -> Column:
    """PRJ-19: energy of a month at a capacity factor."""
    return capacity_factor * capacity * days_in_month(month) * 24


def energy_density(energy: Column, area: Column) -> Column:
    """PRJ-20: for each km2."""
    return ratio(energy, area)


def power_from_factor(factor: Column, capacity: Column) -> Column:
    """PRJ-17."""
    return factor * capacity


def block_energy(half1: Column, half2: Column) -> Column:
    """DOM-15: a day's energy from its two half-day blocks, in the units of a monthly sum before its division by 10."""
    return (half1 + half2) / 400


def history_class(months: Column) -> Column:
    """BIN-1: right-closed bins of months of history; outside (0, 240] missing."""
    return F.when((months > 0) & (months <= 12), "0-12").when((months > 12) & (months <= 60), "12-60").when((months > 60) & (months <= 120), "60-120").when((months > 120) & (months <= 240), "120+")


def plant_type_code(kind: Column) -> Column:
    """BIN-2: ROR 0, STO 1, NA 2, else -1."""
    return F.when(kind == "ROR", 0).when(kind == "STO", 1).when(kind == "NA", 2).otherwise(-1)


def marker_size(capacity: Column) -> Column:
    """BIN-3."""
    return capacity * 0.025


def or_else(first: Column, second: Column) -> Column:
    """PRJ-7, PRJ-8 (new, old) and PRJ-9 (old, new)."""
    return F.coalesce(first, second)


def zero_where(column: Column, condition: Column) -> Column:
    """PRJ-10: 0 where the column is missing and the condition holds."""
    return F.when(column.isNull() & is_true(condition), F.lit(0.0)).otherwise(column)
