"""Scalar functions of the source dialect, with its documented meaning, as plain column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- nulls ---


def isnull(a: Column, b: Column, kind: str | None = None) -> Column:
    """a, or b in the type of a (``kind``, where it differs)."""
    return F.coalesce(a, b.cast(kind) if kind else b)


# --- strings ---


def len_(s: Column) -> Column:
    """Characters without trailing blanks."""
    return F.length(F.rtrim(s))


def datalength(s: Column) -> Column:
    return F.octet_length(s)


def substring(s: Column, start: int, length: int) -> Column:
    """From position ``start``; positions before 1 use up length but give nothing."""
    end = start + length
    first = max(start, 1)
    return F.substring(s, first, max(end - first, 0))


def charindex(part: str, s: Column, start: int = 1) -> Column:
    return F.locate(part, s, max(start, 1))


def like_regex(pattern: str) -> str:
    """A LIKE pattern, with character classes, as a regular expression without anchors."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "%":
            out.append("[\\s\\S]*")
        elif c == "_":
            out.append("[\\s\\S]")
        elif c == "[" and "]" in pattern[i + 1 :]:
            j = pattern.index("]", i + 1)
            out.append("[" + pattern[i + 1 : j].replace("\\", "\\\\") + "]")
            i = j
        else:
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def like(s: Column, pattern: str) -> Column:
    """LIKE with character classes such as [a-z] and [^0-9]."""
    return s.rlike(f"^{like_regex(pattern)}$")


def patindex(pattern: str, s: Column) -> Column:
    """Position of the first match of a LIKE pattern, 0 without one."""
    head = pattern[1:] if pattern.startswith("%") else None
    body = head if head is not None else pattern
    tail = body[:-1] if body.endswith("%") else body + "$"
    regex = like_regex(tail[:-1]) + "$" if tail.endswith("$") and not body.endswith("%") else like_regex(tail)
    return F.regexp_instr(s, F.lit(regex if head is not None else "^" + regex))


def stuff(s: Column, start: int, length: int, new: str) -> Column:
    """Null where ``start`` lies outside the string."""
    return F.when((F.lit(start) >= 1) & (F.lit(start) <= F.length(s)), F.overlay(s, F.lit(new), start, length))


def plus(*parts: Column) -> Column:
    """String +: null if any part is null."""
    return F.concat(*parts)


def concat(*parts: Column) -> Column:
    """CONCAT: nulls count as empty."""
    return F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def concat_ws(sep: str, *parts: Column) -> Column:
    return F.concat_ws(sep, *parts)


def string_split(s: Column, sep: str) -> Column:
    """One row for each part."""
    return F.explode(F.split(s, re.escape(sep)))


def isnumeric(s: Column) -> Column:
    return F.when(s.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"), 1).otherwise(0)


def isdate(s: Column) -> Column:
    return F.when(F.try_to_timestamp(s).isNotNull(), 1).otherwise(0)


# --- dates ---

_STEP = {"second": "seconds", "minute": "minutes", "hour": "hours", "day": "days", "week": "weeks", "month": "months", "year": "years"}


def dateadd(part: str, n: int, d: Column) -> Column:
    """n parts later; months clamp to the month's last day."""
    if part == "quarter":
        part, n = "month", 3 * n
    return d + F.expr(f"interval {n} {_STEP[part]}")


def datediff(part: str, a: Column, b: Column) -> Column:
    """Boundaries of the part crossed from a to b; weeks begin on Sunday."""
    months = lambda x: F.year(x) * 12 + F.month(x)
    if part == "year":
        return F.year(b) - F.year(a)
    if part == "quarter":
        return (F.year(b) * 4 + F.quarter(b)) - (F.year(a) * 4 + F.quarter(a))
    if part == "month":
        return months(b) - months(a)
    if part == "week":
        sunday = lambda x: F.date_sub(F.to_date(x), F.dayofweek(x) - 1)
        return (F.date_diff(sunday(b), sunday(a)) / 7).cast("int")
    if part == "day":
        return F.date_diff(F.to_date(b), F.to_date(a))
    size = {"hour": 3600, "minute": 60, "second": 1}[part]
    whole = lambda x: F.unix_timestamp(F.date_trunc(part, x)) / size
    return (whole(b) - whole(a)).cast("long")


def datepart(part: str, d: Column) -> Column:
    if part in ("dw", "weekday"):
        return F.dayofweek(d)
    return {"year": F.year, "quarter": F.quarter, "month": F.month, "day": F.dayofmonth, "dayofyear": F.dayofyear, "hour": F.hour, "minute": F.minute, "second": F.second}[part](d)


def now(utc: bool = False) -> Column:
    """GETDATE and SYSDATETIME; with ``utc`` GETUTCDATE and SYSUTCDATETIME. One value for a whole query."""
    return F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()) if utc else F.current_timestamp()


#: One-letter date formats, and the letters that the source dialect writes otherwise.
DATE_FORMATS = {"d": "M/d/yyyy", "D": "EEEE, MMMM d, yyyy", "t": "h:mm a", "T": "h:mm:ss a", "g": "M/d/yyyy h:mm a", "G": "M/d/yyyy h:mm:ss a", "s": "yyyy-MM-dd'T'HH:mm:ss", "u": "yyyy-MM-dd HH:mm:ss'Z'", "Y": "MMMM yyyy", "M": "MMMM d"}
DATE_LETTERS = {"dddd": "EEEE", "ddd": "EEE", "fffffff": "SSSSSSS", "fff": "SSS", "ff": "SS", "f": "S", "tt": "a"}


def format_date(d: Column, fmt: str) -> Column:
    """FORMAT of a date or time."""
    words = re.compile("'[^']*'|" + "|".join(sorted(DATE_LETTERS, key=len, reverse=True)))
    return F.date_format(d, DATE_FORMATS.get(fmt) or words.sub(lambda m: DATE_LETTERS.get(m[0], m[0]), fmt))


def format_number(x: Column, fmt: str) -> Column:
    """FORMAT of a number: N, F, C, P and D with digits, 0-padded 000, or a pattern such as #,##0.00."""
    m = re.fullmatch(r"([NFCPDnfcpd])(\d*)", fmt)
    if not m:
        return F.lpad(x.cast("long").cast("string"), len(fmt), "0") if re.fullmatch("0+", fmt) else F.format_number(x, fmt)
    kind, digits = m[1].upper(), int(m[2] or 2)
    if kind == "D":
        size = int(m[2] or 1)
        text = F.abs(x).cast("long").cast("string")
        return F.concat(F.when(x < 0, "-").otherwise(""), F.lpad(text, F.greatest(F.lit(size), F.length(text)), F.lit("0")))
    if kind == "F":
        return F.replace(F.format_number(x, digits), F.lit(","), F.lit(""))
    if kind == "P":
        return F.concat(F.format_number(x * 100, digits), F.lit("%"))
    if kind == "C":
        return F.concat(F.when(x < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(x), digits))
    return F.format_number(x, digits)


def newid() -> Column:
    """NEWID: another random identifier for each row."""
    return F.upper(F.uuid())


def rand() -> Column:
    return F.rand()


# --- JSON and XML ---


def _once(x: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def json_query(doc: Column, path: str) -> Column:
    """JSON_QUERY: the object or array at a path; null for a single value or nothing."""
    return _once(F.try_variant_get(F.try_parse_json(doc), path, "variant"), lambda v: F.when(F.schema_of_variant(v).rlike("^(OBJECT|ARRAY)"), F.to_json(v)))


#: A step of a JSON path: .name, ."any name" or [index].
_JSON_STEP = re.compile(r'\.([A-Za-z_$][\w$]*)|\."([^"]*)"|\[(\d+)\]')


def _steps(path: str) -> tuple[bool, bool, list[str | int]]:
    """append, strict, and the steps of a path like ``append strict $.a."b c"[2]``."""
    m = re.fullmatch(r"\s*(append\s+)?(?:(lax|strict)\s+)?\$(.*?)\s*", path)
    if not m:
        raise ValueError(f"not a JSON path: {path}")
    steps, at = [], 0
    while at < len(m[3]):
        s = _JSON_STEP.match(m[3], at)
        if not s:
            raise ValueError(f"not a JSON path: {path}")
        steps.append(int(s[3]) if s[3] is not None else s[1] if s[1] is not None else s[2])
        at = s.end()
    return bool(m[1]), m[2] == "strict", steps


def json_modify(doc: Column, path: str, value: Column) -> Column:
    """JSON_MODIFY: the document with another value (text or number) at a path.

    As the dialect has it: a missing last key is added, a missing step before it
    changes nothing; a null value deletes a key, and becomes null in an array;
    an index one past the end adds nothing; ``append`` adds to the array at the
    path. ``strict`` raises where the path leads nowhere, and keeps a null value
    as null. Null documents stay null; of texts that are no JSON null results.
    """
    append, strict, steps = _steps(path)
    null = F.parse_json(F.lit("null"))
    new = F.coalesce(F.try_parse_json(F.to_json(F.struct(value.alias("v")), {"ignoreNullFields": "false"})).cast("map<string,variant>")["v"], null)
    missing = F.raise_error(F.lit(f"nothing at {path}")).cast("variant") if strict else None
    is_a = lambda v, kind: F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))

    def held(v):
        """As a variant again, through JSON."""
        return F.parse_json(F.to_json(v))

    def put(v: Column, rest: list) -> Column:
        """``v``: a name for a value that is computed once; so are its entries, else each step would repeat the steps before it."""
        if not rest:
            if not append:
                return new
            longer = held(F.concat(v.try_cast("array<variant>"), F.array(new)))
            return F.when(is_a(v, "ARRAY"), longer).otherwise(missing if strict else v)
        step, nowhere = rest[0], missing if strict else v
        if isinstance(step, int):

            def in_items(items: Column) -> Column:
                changed = held(F.transform(items, lambda x, i: F.when(i == step, put(x, rest[1:])).otherwise(x)))
                return F.when(F.size(items) > step, changed).otherwise(nowhere)

            return _once(F.when(is_a(v, "ARRAY"), v.try_cast("array<variant>")), in_items)
        return _once(F.when(is_a(v, "OBJECT"), v.try_cast("map<string,variant>")), lambda keys: in_keys(keys, step, rest, nowhere))

    def in_keys(keys: Column, step: str, rest: list, nowhere: Column) -> Column:
        last = len(rest) == 1 and not append
        others = F.map_filter(keys, lambda k, _: k != step)
        there = F.map_contains_key(keys, step)
        with_new = lambda x: held(F.map_concat(others, F.create_map(F.lit(step), x)))
        if not last:
            deeper = with_new(_once(F.coalesce(keys[step], null), lambda v: put(v, rest[1:])))
            if append and len(rest) == 1 and not strict:  # appending to what isn't there makes an array
                return F.when(there, deeper).when(keys.isNotNull(), with_new(held(F.array(new)))).otherwise(nowhere)
            return F.when(there, deeper).otherwise(nowhere)
        gone = with_new(null) if strict else held(others)
        changed = F.when(value.isNull(), gone).otherwise(with_new(new))
        return F.when(there if strict else keys.isNotNull(), changed).otherwise(nowhere)

    return F.to_json(_once(F.try_parse_json(doc), lambda v: put(v, steps)))


#: Type numbers of OPENJSON.
JSON_TYPES = [("^VOID", 0), ("^STRING", 1), ("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)", 2), ("^BOOLEAN", 3), ("^ARRAY", 4), ("^OBJECT", 5)]


def openjson(doc: Column) -> Column:
    """OPENJSON of an object: array of (key, value, type), for explode; strings without quotes."""
    entries = F.map_entries(F.try_parse_json(doc).cast("map<string,variant>"))

    def row(e):
        kind = F.schema_of_variant(e.value)
        number = F.coalesce(*[F.when(kind.rlike(p), F.lit(n)) for p, n in JSON_TYPES])
        text = F.when(number == 0, F.lit(None)).when(number == 1, e.value.cast("string")).otherwise(F.to_json(e.value))
        return F.struct(e.key.alias("key"), text.alias("value"), number.alias("type"))

    return F.transform(entries, row)


def openjson_with(doc: Column, schema: str) -> Column:
    """OPENJSON WITH (schema) of an array of objects: array of structs, for explode."""
    return F.from_json(doc, f"array<struct<{schema}>>")


def xml_nodes(doc: Column, schema: str, *path: str) -> Column:
    """.nodes(): the repeated element at a path under the root as array of structs (attributes begin with _), for explode."""
    out = F.from_xml(doc, schema)
    for p in path:
        out = out.getField(p)
    return out


def for_xml(row: str, columns: list[str]) -> Column:
    """FOR XML PATH(row): one element for each row of a group, in the order of its columns; nulls leave theirs out."""
    clean = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    part = lambda x, c: F.coalesce(F.concat(F.lit(f"<{c}>"), clean(x[c]), F.lit(f"</{c}>")), F.lit(""))
    rows = F.array_sort(F.collect_list(F.struct(*columns)))
    return F.array_join(F.transform(rows, lambda x: F.concat(F.lit(f"<{row}>"), *[part(x, c) for c in columns], F.lit(f"</{row}>"))), "")


def datename(part: str, d: Column) -> Column:
    return F.date_format(d, {"month": "MMMM", "weekday": "EEEE"}[part]) if part in ("month", "weekday") else datepart(part, d).cast("string")


#: Style numbers of the source dialect and what they print.
STYLES = {20: "yyyy-MM-dd HH:mm:ss", 21: "yyyy-MM-dd HH:mm:ss.SSS", 101: "MM/dd/yyyy", 102: "yyyy.MM.dd", 103: "dd/MM/yyyy", 104: "dd.MM.yyyy", 105: "dd-MM-yyyy", 108: "HH:mm:ss", 110: "MM-dd-yyyy", 112: "yyyyMMdd", 120: "yyyy-MM-dd HH:mm:ss", 121: "yyyy-MM-dd HH:mm:ss.SSS", 126: "yyyy-MM-dd'T'HH:mm:ss.SSS"}


def convert_style(d: Column, style: int) -> Column:
    return F.date_format(d, STYLES[style])


def parse_style(s: Column, style: int) -> Column:
    return F.try_to_timestamp(s, F.lit(STYLES[style]))


# --- collation ---


def collated(c: Column, name: str = "UTF8_LCASE") -> Column:
    """COLLATE: compares, joins, groups and sorts as the collation says; by default regardless of case, as the dialect's own collations do."""
    return F.collate(c.cast("string"), name)


# --- numbers ---


def divide(a: Column, b: Column) -> Column:
    """Integer / integer, cut towards zero, exact for all 64-bit values; null where b is 0."""
    return F.when(b != 0, F.call_function("div", a, b))


def avg_int(c: Column) -> Column:
    """AVG of integers, cut towards zero: an exact sum over the count."""
    exact = "decimal(38,0)"
    return F.when(F.count(c) > 0, F.call_function("div", F.sum(c.cast(exact)), F.count(c).cast(exact)))


def square(c: Column) -> Column:
    return c * c


# --- comparisons by type ---


def equals_one(c: Column, kind: str) -> Column:
    """``col = 1``: the column itself where it is boolean, else the comparison."""
    return c if kind == "boolean" else c == 1


def try_equals_number(s: Column, n: Column) -> Column:
    """String = number, the string read as a number; null where it is none."""
    return s.try_cast("double") == n
