"""XML Schema simple types as column expressions: hierarchy, validation, parsing, encoding and facets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chars import NCNAME_JAVA

NAMESPACE, INSTANCE = "http://www.w3.org/2001/XMLSchema", "http://www.w3.org/2001/XMLSchema-instance"

#: Each built-in type's base, and of the list types the items'.
BASE = {
    "anySimpleType": "anyType",
    **dict.fromkeys(("string", "boolean", "decimal", "float", "double", "duration", "dateTime", "time", "date", "gYearMonth", "gYear", "gMonthDay", "gDay", "gMonth", "hexBinary", "base64Binary", "anyURI", "QName", "NOTATION"), "anySimpleType"),
    "normalizedString": "string", "token": "normalizedString", "language": "token", "NMTOKEN": "token", "Name": "token", "NCName": "Name", "ID": "NCName", "IDREF": "NCName", "ENTITY": "NCName",
    "integer": "decimal", "nonPositiveInteger": "integer", "negativeInteger": "nonPositiveInteger", "long": "integer", "int": "long", "short": "int", "byte": "short",
    "nonNegativeInteger": "integer", "unsignedLong": "nonNegativeInteger", "unsignedInt": "unsignedLong", "unsignedShort": "unsignedInt", "unsignedByte": "unsignedShort", "positiveInteger": "nonNegativeInteger",
    "NMTOKENS": "anySimpleType", "IDREFS": "anySimpleType", "ENTITIES": "anySimpleType", "yearMonthDuration": "duration", "dayTimeDuration": "duration",
}
ITEMS = {"NMTOKENS": "NMTOKEN", "IDREFS": "IDREF", "ENTITIES": "ENTITY"}
PRIMITIVE = tuple(t for t, b in BASE.items() if b == "anySimpleType" and t not in ITEMS)
RANGES = {
    "long": (-(2**63), 2**63 - 1), "int": (-(2**31), 2**31 - 1), "short": (-(2**15), 2**15 - 1), "byte": (-128, 127),
    "unsignedLong": (0, 2**64 - 1), "unsignedInt": (0, 2**32 - 1), "unsignedShort": (0, 2**16 - 1), "unsignedByte": (0, 255),
    "nonPositiveInteger": (None, 0), "negativeInteger": (None, -1), "nonNegativeInteger": (0, None), "positiveInteger": (1, None), "integer": (None, None),
}
_ZONE = r"(?:Z|[+-](?:0\d|1[0-3]):[0-5]\d|[+-]14:00)?"
_DATE = r"-?(?:[1-9]\d{3,}|0\d{3})-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])"
_TIME = r"(?:(?:[01]\d|2[0-3]):[0-5]\d:[0-5]\d(?:\.\d+)?|24:00:00(?:\.0+)?)"
_NMTOKEN = NCNAME_JAVA[NCNAME_JAVA.index("[", 1) :].rstrip("*").replace("[-", "[:\\-", 1) + "+"
LEXICAL = {
    "boolean": "true|false|1|0", "decimal": r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)", "float": r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?|[+-]?INF|NaN",
    "duration": r"-?P(?=\d|T\d)(?:\d+Y)?(?:\d+M)?(?:\d+D)?(?:T(?=\d)(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?", "yearMonthDuration": r"-?P(?=\d)(?:\d+Y)?(?:\d+M)?",
    "dayTimeDuration": r"-?P(?=\d|T\d)(?:\d+D)?(?:T(?=\d)(?:\d+H)?(?:\d+M)?(?:\d+(?:\.\d+)?S)?)?", "dateTime": f"{_DATE}T{_TIME}{_ZONE}", "time": _TIME + _ZONE, "date": _DATE + _ZONE,
    "gYearMonth": rf"-?(?:[1-9]\d{{3,}}|0\d{{3}})-(?:0[1-9]|1[0-2]){_ZONE}", "gYear": rf"-?(?:[1-9]\d{{3,}}|0\d{{3}}){_ZONE}", "gMonthDay": rf"--(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01]){_ZONE}",
    "gDay": rf"---(?:0[1-9]|[12]\d|3[01]){_ZONE}", "gMonth": rf"--(?:0[1-9]|1[0-2]){_ZONE}", "hexBinary": "(?:[0-9a-fA-F]{2})*",
    "base64Binary": r"(?:(?:[A-Za-z0-9+/]\s?){4})*(?:(?:[A-Za-z0-9+/]\s?){3}=|(?:[A-Za-z0-9+/]\s?){2}=\s?=)?", "QName": f"(?:{NCNAME_JAVA}:)?{NCNAME_JAVA}", "normalizedString": r"[^\r\n\t]*",
    "token": r"(?:[^\s]+(?: [^\s]+)*)?", "language": "[a-zA-Z]{1,8}(?:-[a-zA-Z0-9]{1,8})*", "NMTOKEN": _NMTOKEN, "Name": f"[:]?{NCNAME_JAVA}(?::(?:{_NMTOKEN})?)*", "NCName": NCNAME_JAVA,
    "integer": r"[+-]?\d+",
}
LEXICAL["double"] = LEXICAL["float"]


def normalize_type(name: str) -> str:
    """Without prefix, and from snake to camel case."""
    name = name.rpartition(":")[2]
    if name in BASE or name == "anyType":
        return name
    head, *rest = name.split("_")
    camel = head + "".join(x.capitalize() for x in rest)
    upper = {"qname": "QName", "qName": "QName", "ncName": "NCName", "ncname": "NCName", "name": "Name", "id": "ID", "idref": "IDREF", "idrefs": "IDREFS", "nmtoken": "NMTOKEN", "nmtokens": "NMTOKENS", "entity": "ENTITY", "entities": "ENTITIES", "anyUri": "anyURI", "notation": "NOTATION", "base64binary": "base64Binary"}
    return upper.get(camel, camel)


def chain(name: str) -> list[str]:
    """The type and all it derives from."""
    out = [normalize_type(name)]
    while out[-1] in BASE:
        out.append(BASE[out[-1]])
    return out


def derived_from(name: str, other: str) -> bool:
    return other in chain(name)


def primitive_base(name: str) -> str | None:
    return next((t for t in chain(name) if t in PRIMITIVE), None)


def is_numeric(name: str) -> bool:
    return primitive_base(name) in ("decimal", "float", "double")


def is_date_time(name: str) -> bool:
    return primitive_base(name) in ("dateTime", "time", "date", "gYearMonth", "gYear", "gMonthDay", "gDay", "gMonth")


def is_binary(name: str) -> bool:
    return primitive_base(name) in ("hexBinary", "base64Binary")


def type_uri(name: str) -> str:
    return f"{NAMESPACE}#{normalize_type(name)}"


def qualified_name(name: str, prefix: str = "xs") -> str:
    return f"{prefix}:{normalize_type(name)}"


def whitespace_mode(name: str) -> str:
    t = normalize_type(name)
    return "preserve" if t in ("string", "anyType", "anySimpleType") else "replace" if t == "normalizedString" else "collapse"


def normalize_whitespace(value: Column, mode: str) -> Column:
    if mode == "preserve":
        return value
    flat = F.translate(value, "\t\n\r", "   ")
    return flat if mode == "replace" else F.trim(F.regexp_replace(flat, " +", " "))


def to_spark_type(name: str) -> T.DataType:
    t, p = normalize_type(name), primitive_base(name)
    if t in ITEMS:
        return T.ArrayType(T.StringType())
    if t in RANGES:
        own = {"long": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "byte": T.ByteType(), "unsignedLong": T.DecimalType(20, 0), "unsignedInt": T.LongType(), "unsignedShort": T.IntegerType(), "unsignedByte": T.ShortType()}
        return own.get(t, T.DecimalType(38, 0))
    return {"boolean": T.BooleanType(), "decimal": T.DecimalType(38, 18), "float": T.FloatType(), "double": T.DoubleType(), "date": T.DateType(), "dateTime": T.TimestampType(), "hexBinary": T.BinaryType(), "base64Binary": T.BinaryType()}.get(p, T.StringType())


def infer_type(kind: T.DataType) -> str:
    """The XSD type for a Spark type."""
    names = {T.StringType: "string", T.BooleanType: "boolean", T.ByteType: "byte", T.ShortType: "short", T.IntegerType: "int", T.LongType: "long", T.FloatType: "float", T.DoubleType: "double", T.DecimalType: "decimal", T.DateType: "date", T.TimestampType: "dateTime", T.TimestampNTZType: "dateTime", T.BinaryType: "base64Binary"}
    return names.get(type(kind), "anySimpleType")


def _days_ok(value: Column) -> Column:
    """Whether the day exists in its month, for values that fit the pattern."""
    parts = [F.regexp_extract(value, r"\A-?(\d+)-(\d\d)-(\d\d)", i).cast("int") for i in (1, 2, 3)]
    year, month, day = parts
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    last = F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return day <= last


def _fits(value: Column, name: str) -> Column:
    return value.rlike(rf"\A(?:{LEXICAL[name]})\z")


def validate(value: Column, name: str) -> Column:
    """Whether a text is of the type. Numbers, dates, names and binaries may have white space around them."""
    t = normalize_type(name)
    if t in ITEMS:
        return F.forall(F.split(F.trim(value), r"\s+"), lambda x: validate(x, ITEMS[t])) & (F.trim(value) != "")
    if t in ("string", "anyURI", "NOTATION", "anyType", "anySimpleType"):
        return value.isNotNull()
    if t in ("normalizedString", "token"):
        return _fits(value, t)
    v = F.trim(value)
    if t in RANGES:
        low, high = RANGES[t]
        ok = _fits(v, "integer")
        sign = v.startswith("-")
        digits = F.regexp_replace(F.regexp_replace(v, r"\A[+-]", ""), r"\A0+(?=\d)", "")
        sign = sign & (digits != "0")

        def above(n: int) -> Column:  # |value| > n, by length and then by digits
            return (F.length(digits) > len(str(n))) | (F.length(digits) == len(str(n))) & (digits > str(n))

        if high is not None:
            ok = ok & (~(~sign & above(high)) if high >= 0 else sign & (above(-high) | (digits == str(-high))))
        if low is not None:
            ok = ok & (~(sign & above(-low)) if low <= 0 else ~sign & (above(low) | (digits == str(low))))
        return ok
    if t in ("date", "dateTime"):
        return _fits(v, t) & _days_ok(v)
    if t == "gMonthDay":
        return _fits(v, t) & _days_ok(F.concat(F.lit("2000"), F.substring(v, 2, 6)))
    return _fits(v, {"ID": "NCName", "IDREF": "NCName", "ENTITY": "NCName"}.get(t, t))


def parse(value: Column, name: str, strict: bool = False) -> Column:
    """The value as a Spark type, null for what doesn't parse; ``strict`` also enforces ranges."""
    t, p = normalize_type(name), primitive_base(name)
    v = normalize_whitespace(value, whitespace_mode(t))
    if t in ITEMS:
        return F.filter(F.split(v, " "), lambda x: x != "")
    if p == "boolean":
        out = F.when(v.isin("true", "1"), True).when(v.isin("false", "0"), False)
    elif t in RANGES:
        out = F.when(_fits(v, "integer"), v.try_cast(to_spark_type(t) if strict else T.DecimalType(38, 0)))
    elif p == "decimal":
        out = F.when(_fits(v, "decimal"), v.try_cast(T.DecimalType(38, 18)))
    elif p in ("float", "double"):
        out = F.when(_fits(v, p), F.replace(v, F.lit("INF"), F.lit("Infinity")).try_cast(p))
    elif p == "date":
        out = F.when(validate(v, "date"), F.try_to_date(F.substring(v, 1, 10)))
    elif p == "dateTime":
        out = F.when(validate(v, "dateTime"), F.try_to_timestamp(v))
    elif p == "hexBinary":
        out = F.when(_fits(v, p), F.unhex(v))
    elif p == "base64Binary":
        out = F.when(_fits(v, p), F.unbase64(F.regexp_replace(v, r"\s", "")))
    elif p == "duration":
        part = lambda unit, kind="long": F.coalesce(F.regexp_extract(v, unit, 1).try_cast(kind), F.lit(0).cast(kind))
        fields = {"years": r"(\d+)Y", "months": r"\A[^T]*?(\d+)M", "days": r"(\d+)D", "hours": r"(\d+)H", "minutes": r"T.*?(\d+)M"}
        out = F.when(_fits(v, t), F.struct(v.startswith("-").alias("negative"), *[part(r).alias(k) for k, r in fields.items()], part(r"([\d.]+)S", "double").alias("seconds")))
    elif p == "QName":
        has = v.contains(":")
        out = F.when(_fits(v, p), F.struct(F.when(has, F.substring_index(v, ":", 1)).alias("prefix"), F.substring_index(v, ":", -1).alias("local")))
    else:
        out = F.when(validate(v, t), v)
    return F.when(validate(v, t), out) if strict and t in RANGES else out


def gregorian_parts(value: Column, name: str) -> Column:
    """year, month and day of a Gregorian type, null for what it lacks."""
    t = normalize_type(name)
    v = F.trim(value)
    grab = {"gYear": (r"\A(-?\d+)", None, None), "gYearMonth": (r"\A(-?\d+)-", r"\A-?\d+-(\d\d)", None), "gMonthDay": (None, r"\A--(\d\d)", r"\A--\d\d-(\d\d)"), "gDay": (None, None, r"\A---(\d\d)"), "gMonth": (None, r"\A--(\d\d)", None)}[t]
    fields = [(F.regexp_extract(v, r, 1).try_cast("int") if r else F.lit(None).cast("int")).alias(k) for k, r in zip(("year", "month", "day"), grab, strict=True)]
    return F.when(validate(v, t), F.struct(*fields))


def encode(value: Column, name: str) -> Column:
    """The text of a Spark value; null becomes empty."""
    p = primitive_base(name)
    if p == "boolean":
        out = F.when(value, "true").otherwise("false")
    elif p in ("float", "double"):
        out = F.when(F.isnan(value), "NaN").when(value == float("inf"), "INF").when(value == float("-inf"), "-INF").otherwise(value.cast("string"))
    elif p == "dateTime":
        out = F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    elif p == "date":
        out = F.date_format(value, "yyyy-MM-dd")
    elif p == "hexBinary":
        out = F.hex(value)
    elif p == "base64Binary":
        out = F.base64(value)
    elif normalize_type(name) in ITEMS:
        out = F.array_join(value, " ")
    else:
        out = value.cast("string")
    return F.when(value.isNull(), "").otherwise(out)


def _java_pattern(pattern: str) -> str:
    return pattern.replace(r"\i", "[A-Za-z_:]").replace(r"\c", r"[A-Za-z0-9._:\-]")


def _measure(value: Column, name: str) -> Column:
    t = normalize_type(name)
    if t in ITEMS:
        return F.size(F.filter(F.split(value, r"\s+"), lambda x: x != ""))
    if t == "hexBinary":
        return F.length(value) / 2
    if t == "base64Binary":
        return F.octet_length(F.unbase64(F.regexp_replace(value, r"\s", "")))
    return F.length(value)


def _comparable(value: Column, name: str) -> Column:
    p = primitive_base(name)
    if p == "decimal":
        return value.try_cast(T.DecimalType(38, 10))
    if p in ("float", "double"):
        return F.replace(value, F.lit("INF"), F.lit("Infinity")).try_cast("double")
    if p == "duration":
        d = parse(value, "duration")
        days = d["years"] * 365.25 + d["months"] * 30.4375 + d["days"]
        return F.when(d["negative"], -1).otherwise(1) * (days * 86400 + d["hours"] * 3600 + d["minutes"] * 60 + d["seconds"])
    if is_date_time(name):
        return F.regexp_replace(value, r"(?:Z|[+-]\d\d:\d\d)\z", "")
    return value


def validate_facets(value: Column, name: str, facets: list[tuple[str, object]]) -> Column:
    """Valid, and all facets hold; of several enumerations one."""
    mode = next((str(v) for k, v in facets if k == "whiteSpace"), whitespace_mode(name))
    v = normalize_whitespace(value, mode)
    ok = validate(v, name)
    if allowed := [str(x) for k, x in facets if k == "enumeration"]:
        ok = ok & v.isin(allowed)
    digits = F.regexp_replace(F.regexp_replace(v, r"\A[+-]?0*", ""), r"(\.\d*?)0+\z", "$1")
    for k, x in facets:
        if k in ("length", "minLength", "maxLength"):
            n = _measure(v, name)
            ok = ok & (n == x if k == "length" else n >= x if k == "minLength" else n <= x)
        elif k == "pattern":
            ok = ok & v.rlike(rf"\A(?:{_java_pattern(str(x))})\z")
        elif k in ("minInclusive", "maxInclusive", "minExclusive", "maxExclusive"):
            a, b = _comparable(v, name), _comparable(F.lit(str(x)), name)
            ok = ok & {"minInclusive": a >= b, "maxInclusive": a <= b, "minExclusive": a > b, "maxExclusive": a < b}[k]
        elif k == "totalDigits":
            ok = ok & (F.length(F.regexp_replace(digits, r"\D", "")) <= x)
        elif k == "fractionDigits":
            ok = ok & (F.length(F.regexp_extract(digits, r"\.(\d*)\z", 1)) <= x)
        elif k not in ("enumeration", "whiteSpace"):
            raise ValueError(f"no such facet: {k}")
    return ok
