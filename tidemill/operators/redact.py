"""Redaction of sensitive fields and truncation of long ones in log tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidemill.functions.columns import name, require

# A key that contains one of these words hides its value.
SENSITIVE = ("password", "token", "secret", "apikey", "api_key", "authorization", "cookie", "credit_card", "ssn")
REDACTED = "[REDACTED]"

# The longest text kept per log field.
FIELD_LIMITS = {"userAgent": 500, "responsePreview": 500, "errorMessage": 1000}


def is_sensitive(key: str) -> bool:
    return any(word in key.lower() for word in SENSITIVE)


#: A string (also one cut off by the end), a mark, a bare value or white space: every text falls into these pieces.
PIECE = r'(?s)"[^"\\]*+(?:\\.[^"\\]*+)*+(?:"|\\?\z)|[{}\[\]:,]|[^\s{}\[\]:,"]++|\s++'


def _names_secret(piece: Column) -> Column:
    """Whether a quoted key contains a sensitive word; escapes in it are resolved first."""
    plain = F.coalesce(F.get_json_object(F.concat(F.lit('{"k":'), piece, F.lit("}")), "$.k"), piece)
    key = F.when(piece.contains("\\"), plain).otherwise(piece)
    return piece.startswith('"') & F.lower(key).rlike("|".join(re.escape(w) for w in SENSITIVE))


def _hidden(pieces: Column, nested: bool) -> Column:
    """First and last place of every hidden value, by one pass over the pieces.

    The pass keeps the depth, the depth of the outermost array (inside, nothing is hidden), the depth and
    the first place of a hidden object or array, whether a value to hide comes next, and the last piece.
    """
    fields = {"at": 0, "depth": 0, "array": 0, "hide": 0, "first": 0, "armed": False, "last": ""}
    none = F.array().cast("array<struct<a:int,b:int>>")
    zero = F.struct(*[F.lit(v).alias(k) for k, v in fields.items()], none.alias("spans"))

    def place(a: Column, b: Column) -> Column:
        return F.struct(a.alias("a"), b.alias("b"))

    def step(s: Column, piece: Column) -> Column:
        opens, closes = piece.isin("{", "["), piece.isin("}", "]")
        hit = s["armed"] & ~closes & ~piece.isin(":", ",")
        free = (s["hide"] == 0) & (s["array"] == 0)
        ends = closes & (s["hide"] > 0) & (s["hide"] == s["depth"])
        level = s["depth"] > 0 if nested else s["depth"] == 1
        after = {
            "depth": F.when(opens, s["depth"] + 1).when(closes, F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"]),
            "array": F.when((piece == "[") & free & ~hit, s["depth"] + 1).when(closes & (s["array"] == s["depth"]), 0).otherwise(s["array"]),
            "hide": F.when(hit & opens, s["depth"] + 1).when(ends, 0).otherwise(s["hide"]),
            "first": F.when(hit & opens, s["at"]).otherwise(s["first"]),
            "armed": F.when(piece == ":", free & level & _names_secret(s["last"])).otherwise(False),
            "last": piece,
            "spans": F.when(hit & ~opens, F.array_append(s["spans"], place(s["at"], s["at"])))
            .when(ends, F.array_append(s["spans"], place(s["first"], s["at"]))).otherwise(s["spans"]),
        }
        space = piece.rlike(r"\A\s")
        kept = [F.when(space, s[k]).otherwise(after[k]).alias(k) for k in [*list(fields)[1:], "spans"]]
        return F.struct((s["at"] + 1).alias("at"), *kept)

    def done(s: Column) -> Column:
        # An object or array that the end cuts off is hidden to the end.
        return F.when(s["hide"] > 0, F.array_append(s["spans"], place(s["first"], s["at"] - 1))).otherwise(s["spans"])

    return F.aggregate(pieces, zero, step, done)


def _without(pieces: Column, spans: Column) -> Column:
    """The pieces as one text, each span replaced by the mark."""
    mark = F.array(F.lit(f'"{REDACTED}"'))

    def up_to(span: Column, i: Column) -> Column:
        start = F.when(i == 0, 0).otherwise(spans[i - 1]["b"] + 1)
        return F.concat(F.slice(pieces, start + 1, span["a"] - start), mark)

    rest = F.coalesce(F.try_element_at(spans, F.lit(-1))["b"] + 1, F.lit(0))
    tail = F.slice(pieces, rest + 1, F.greatest(F.size(pieces) - rest, F.lit(0)))
    return F.array_join(F.concat(F.flatten(F.transform(spans, up_to)), tail), "")


def redact_json(text: Column, nested: bool = True, compact: bool = False) -> Column:
    """JSON text with the values of sensitive keys replaced; all else stays byte for byte: numbers, spacing, order, repeated keys.

    Column functions only. Nested objects are searched (not with ``nested=False``), arrays are left alone. Text that is cut
    off is redacted up to its end; outside braces nothing is a key, so plain text stays. Rows that mention no sensitive word
    and no escaped letter are not taken apart. ``compact`` drops the white space between the pieces of all other rows.
    """
    suspect = F.lower(text).rlike("|".join(re.escape(w) for w in SENSITIVE) + r"|\\u")
    # Arrays of one element, so that pieces and spans are worked out once.
    pieces = F.regexp_extract_all(text, F.lit(PIECE), 0)
    if compact:
        pieces = F.filter(pieces, lambda p: ~p.rlike(r"\A\s"))
    bound = F.transform(F.array(pieces), lambda p: F.struct(p.alias("p"), _hidden(p, nested).alias("s")))
    return F.when(suspect, F.transform(bound, lambda x: _without(x["p"], x["s"]))[0]).otherwise(text)


def redact_typed(column: Column, data_type: T.DataType) -> Column:
    """Redact a struct column by its schema, without parsing anything."""
    if not isinstance(data_type, T.StructType):
        return column
    parts = [
        (F.lit(REDACTED) if is_sensitive(f.name) else redact_typed(column.getField(f.name), f.dataType)).alias(f.name)
        for f in data_type.fields
    ]
    return F.when(column.isNotNull(), F.struct(*parts))


def redact_table(df: DataFrame, json_columns: Sequence[str] = ()) -> DataFrame:
    """Redact sensitive columns, struct columns by schema, and the named JSON text columns."""
    require(df, json_columns)
    out = []
    for f in df.schema.fields:
        if is_sensitive(f.name):
            value = F.lit(REDACTED)
        elif f.name in json_columns:
            value = redact_json(name(f.name))
        else:
            value = redact_typed(name(f.name), f.dataType)
        out.append(value.alias(f.name))
    return df.select(*out)


def shorten(df: DataFrame, limits: Mapping[str, int] | None = None, blank: Sequence[str] = ()) -> DataFrame:
    """Cut text fields to their limits; empty text and zeros in ``blank`` columns become NULL."""
    limits = FIELD_LIMITS if limits is None else limits
    out = []
    for f in df.schema.fields:
        value = name(f.name)
        if f.name in blank:
            empty = F.lit("") if isinstance(f.dataType, T.StringType) else F.lit(0).cast(f.dataType)
            value = F.nullif(value, empty)
        if f.name in limits:
            value = F.substring(value, 1, limits[f.name])
        out.append(value.alias(f.name))
    return df.select(*out)


def sanitize_log(
    df: DataFrame, json_columns: Sequence[str] = (), limits: Mapping[str, int] | None = None, blank: Sequence[str] = ()
) -> DataFrame:
    """What every log row goes through on its way in; batch and streaming alike."""
    return shorten(redact_table(df, json_columns), limits, blank)
