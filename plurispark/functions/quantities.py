"""Exact byte amounts, durations, accelerators and resource requests.

Digits are ASCII throughout. Byte amounts are ``decimal(38,0)``: a whole part or a
fraction of more than 38 digits is refused like any other inexact amount.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BYTES = "decimal(38,0)"
GIB = 1024**3
#: Fixed value: 5 to the 30th, which turns a remainder of 2^30 into 30 decimals.
_FIVE_30 = 5**30


def _big(value: int) -> Column:
    return F.lit(str(value)).cast(_BYTES)


def _raised(base: int, exponent: Column, top: int) -> Column:
    """``base ** exponent`` for exponents up to *top*, NULL beyond."""
    return F.get(F.array(*[_big(base**i) for i in range(top + 1)]), exponent)


def _div(a: Column, b: Column) -> Column:
    """The exact quotient of an exact division."""
    return F.try_divide(a, b).try_cast(_BYTES)


def _once(value: Column, use) -> Column:
    """``use(value)`` with *value* computed once per row, however often *use* refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def whole_bytes(amount: Column, unit: Column) -> Column:
    """Scale a decimal text by *unit* bytes; NULL unless positive and whole.

    Whole and fraction digits are scaled apart, because decimal multiplication
    would round to six places. With *k* fraction digits, ``fraction * unit``
    must be divisible by ``10**k``; a unit divisible by ``2**k`` is reduced by
    it first, so that long binary fractions stay within the type.
    """
    def by_fraction(v: Column) -> Column:
        def reduced_unit(h: Column) -> Column:
            top = F.when(h["reduced"], _div(v["unit"], h["halves"])).otherwise(v["unit"])
            scaled = F.struct(
                F.try_multiply(v["digits"].try_cast(_BYTES), top).cast(_BYTES).alias("scaled"),
                F.when(h["reduced"], _raised(5, v["k"], 54)).otherwise(_raised(10, v["k"], 37)).alias("bottom"),
            )
            return _once(scaled, lambda x: F.when((x["scaled"] % x["bottom"]) == 0, _div(x["scaled"], x["bottom"])))

        halves = _once(_raised(2, v["k"], 60), lambda h: F.struct(h.alias("halves"), ((v["unit"] % h) == 0).alias("reduced")))
        return _once(halves, reduced_unit)

    def total(v: Column) -> Column:
        exact = F.try_multiply(v["whole"].try_cast(_BYTES), v["unit"]).cast(_BYTES)
        return F.when(v["k"] == 0, exact).otherwise(F.try_add(exact, by_fraction(v)).cast(_BYTES))

    def parts(a: Column) -> Column:
        digits = F.rtrim(F.when(F.contains(a, F.lit(".")), F.substring_index(a, ".", -1)).otherwise(F.lit("")), F.lit("0"))
        return F.when(a.rlike(r"^[0-9]+(?:\.[0-9]+)?\z"), _once(digits, lambda d: F.struct(
            F.substring_index(a, ".", 1).alias("whole"), d.alias("digits"), F.length(d).alias("k"), unit.cast(_BYTES).alias("unit"))))

    found = _once(_once(amount, parts), lambda v: F.when(v.isNotNull(), total(v)))
    return _once(found, lambda n: F.when(n > 0, n))


def _lookup(factors: dict[str, int], unit: Column) -> Column:
    table = F.create_map(*[x for name, n in factors.items() for x in (F.lit(name), _big(n))])
    return F.try_element_at(table, unit)


#: Size letters by rising exponent.
_LETTERS = "kmgtpe"
_RECIPE_UNITS = {"b": 1}
_OFFER_UNITS = {"": GIB, "b": 1}
for _power, _letter in enumerate(_LETTERS, 1):
    for _suffix, _base in (("", 1000), ("b", 1000), ("i", 1024), ("ib", 1024)):
        _RECIPE_UNITS[_letter + _suffix] = _base**_power
    for _suffix in ("b", "ib"):
        _OFFER_UNITS[_letter + _suffix] = 1024**_power


def recipe_memory_bytes(c: Column) -> Column:
    """Recipe grammar: a unit is required; ``i`` units are binary, others decimal."""
    pattern = r"^[0-9]+(?:\.[0-9]+)?[ \t\n\r\f\x0b]*(?:[KMGTPE]i?B?|kB?|B)\z"

    def scaled(c: Column) -> Column:
        amount = F.rtrim(c, F.lit("KMGTPEikB"))
        unit = F.lower(F.substring(c, F.length(amount) + 1, F.lit(3)))
        return F.when(c.rlike(pattern), whole_bytes(F.rtrim(amount, F.lit(" \t\n\r\f\x0b")), _lookup(_RECIPE_UNITS, unit)))

    return _once(c, scaled)


def offer_memory_bytes(c: Column) -> Column:
    """Offer grammar: bare numbers are GiB and every unit is binary, in any case."""
    pattern = r"(?i)^[0-9]+(?:\.[0-9]+)?(?:[KMGTPE]I?B|B)?\z"

    def scaled(c: Column) -> Column:
        amount = F.rtrim(c, F.lit("KMGTPEIBkmgtpeib"))
        unit = F.lower(F.substring(c, F.length(amount) + 1, F.lit(3)))
        return F.when(c.rlike(pattern), whole_bytes(amount, _lookup(_OFFER_UNITS, unit)))

    return _once(c, scaled)


def duration_seconds(c: Column) -> Column:
    """Ordered ``d h m s`` components, each optional, in seconds; NULL unless positive."""
    pattern = r"^(?:([0-9]+)d)?(?:([0-9]+)h)?(?:([0-9]+)m)?(?:([0-9]+)s)?\z"
    total = F.lit(0).cast("long")
    for group, unit in enumerate((86400, 3600, 60, 1), 1):
        part = F.coalesce(F.nullif(F.regexp_extract(c, pattern, group), F.lit("")), F.lit("0"))
        total = total + part.try_cast("long") * unit
    return F.when(c.rlike(pattern) & (total > 0), total)


def gib(value: Column) -> Column:
    """Exact GiB of a positive byte count as decimal text, without trailing zeros."""
    amount = value.cast(_BYTES)
    rest = amount % _big(GIB)
    whole = F.try_divide((amount - rest).cast(_BYTES), _big(GIB)).cast(_BYTES)
    digits = F.lpad((rest * _big(_FIVE_30)).cast(_BYTES).cast("string"), 30, "0")
    text = F.concat(whole.cast("string"), F.lit("."), digits)
    return F.when(amount > 0, F.rtrim(F.rtrim(text, F.lit("0")), F.lit(".")))


def accelerator(c: Column) -> Column:
    """``NAME[:COUNT]`` as ``struct<name,count>``; NULL when malformed or reserved."""
    pattern = r"^([A-Za-z0-9][A-Za-z0-9_.-]*)(?::([1-9][0-9]*))?\z"
    name = F.regexp_extract(c, pattern, 1)
    text = F.regexp_extract(c, pattern, 2)
    count = F.when(text == "", F.lit(1)).otherwise(F.when(text != "", text).try_cast("int"))
    good = (name != "") & ~name.isin("name", "count") & count.isNotNull()
    return F.when(good, F.struct(name.alias("name"), count.alias("count")))


def accelerator_matches(wanted: Column, offered: Column) -> Column:
    """Equal counts and the same type; a wanted ``gpu`` takes any type."""
    name = F.lower(wanted["name"])
    same = (wanted["count"] == offered["count"]) & (
        (name == "gpu") | (name == F.lower(offered["name"]))
    )
    return F.coalesce(same, F.lit(False))


#: What a recipe may ask for.
REQUEST_KEYS = ("cpus", "memory", "gpus")


def task_request(resources: Column) -> Column:
    """A recipe's resource map as ``struct<cpus,gpus,memory_bytes,errors>``.

    CPUs default to one and must be whole, GPUs default to none, memory is
    optional; a walltime and unknown keys are refused. All errors are listed.
    """
    given = F.coalesce(resources, F.create_map().cast("map<string,string>"))
    asked = F.map_keys(given)
    cpus_text = F.when(F.map_contains_key(given, "cpus"), F.try_element_at(given, F.lit("cpus"))).otherwise(F.lit("1"))
    gpus_text = F.when(F.map_contains_key(given, "gpus"), F.try_element_at(given, F.lit("gpus"))).otherwise(F.lit("0"))
    cpus = F.when(cpus_text.rlike(r"^[0-9]+(\.0+)?\z"), F.substring_index(cpus_text, ".", 1)).try_cast("int")
    gpus = F.when(gpus_text.rlike(r"^[0-9]+\z"), gpus_text).try_cast("int")
    memory = recipe_memory_bytes(F.try_element_at(given, F.lit("memory")))
    unknown = F.array_sort(F.array_except(asked, F.array(*[F.lit(k) for k in (*REQUEST_KEYS, "time_limit")])))
    errors = F.filter(
        F.array(
            F.when(F.map_contains_key(given, "time_limit"), F.lit("time_limit is not supported")),
            F.when(F.size(unknown) > 0, F.concat(F.lit("unsupported: "), F.array_join(unknown, ", "))),
            F.when(F.coalesce(cpus, F.lit(0)) <= 0, F.lit("cpus must be a positive whole number")),
            F.when(gpus.isNull(), F.lit("gpus must be a whole number")),
            F.when(F.map_contains_key(given, "memory") & memory.isNull(),
                   F.lit("memory must be whole bytes with a unit")),
        ),
        lambda e: e.isNotNull(),
    )
    return F.struct(
        cpus.alias("cpus"), gpus.alias("gpus"), memory.alias("memory_bytes"), errors.alias("errors")
    )
