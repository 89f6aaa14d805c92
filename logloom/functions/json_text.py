"""Strict JSON parsing of a text line and the text form of JSON scalars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The characters that count as white space around a line or value.
JS_WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\ufeff\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
MAX_SAFE_INTEGER = 9007199254740992
SMALLEST_WHOLE = 2.2250738585072014e-308  # smaller doubles have fewer bits
_NUMBER = r"-?[0-9]++(?:\.[0-9]++)?+(?:[eE][+-]?[0-9]++)?+"
_TOKEN = rf'"(?:[^"\\]++|\\.)*+"|{_NUMBER}|[^"0-9-]++|-'
_ODD_NUMBER = r"[0-9][.eE]|-0|[0-9]{16}"

_SENTINEL = "\u2060end-of-line\u2060"


def js_trim(text: Column) -> Column:
    return F.btrim(text, F.lit(JS_WHITESPACE))


def bind(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row and then only referred to.

    A plain projection may be merged into the filters and projections above it, which would
    repeat an expensive expression in each. A one-row generator is never merged.
    """
    values = F.struct(*[value.alias(name) for name, value in columns.items()])
    return rows.select("*", F.inline(F.array(values)))


def with_parsed(lines: DataFrame, text: str, out: str = "parsed") -> DataFrame:
    """Add variant ``out`` holding the value of ``text`` if that is exactly one JSON value, else NULL.

    ``try_parse_json`` ignores what follows the first complete value. The line is
    therefore parsed inside an array closed by a sentinel: the sentinel is the second and
    last element only if the line was one whole value. One parse is enough for every
    line that does not itself contain the sentinel text.
    """
    raw = f"_{out}_array"
    line, array = F.col(text), F.col(f"_{out}_array")
    array_text = F.concat(F.lit("["), line, F.lit(f',"{_SENTINEL}"]'))
    whole = (F.try_variant_get(array, "$[1]", "string") == _SENTINEL) & F.try_variant_get(
        array, "$[2]", "variant"
    ).isNull()
    wrapped = F.concat(F.lit("["), line, F.lit("]"))
    whole_slow = (
        F.try_parse_json(wrapped).isNotNull()
        & (F.json_array_length(wrapped) == 1)
        & F.try_parse_json(F.concat(F.lit('{"r":'), line, F.lit("}"))).isNotNull()
    )
    is_one_value = F.when(line.contains(_SENTINEL), whole_slow).otherwise(whole)
    value = F.when(F.coalesce(is_one_value, F.lit(False)), F.try_variant_get(array, "$[0]", "variant"))
    return bind(lines.withColumn(raw, F.try_parse_json(array_text)), **{out: value}).drop(raw)


def json_kind(value: Column) -> Column:
    """STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, VOID, OBJECT<..> or ARRAY<..>."""
    return F.schema_of_variant(value)


def is_json_null(parsed: str) -> Column:
    return F.is_variant_null(F.col(parsed))


def js_number_text(number: Column) -> Column:
    """Shortest decimal text of a double, plain below 1e21 and down to 1e-6."""
    magnitude = F.abs(number)
    # Every text of up to 15 digits is the only one of its length that reads back to its double, except for
    # numbers so small that they have fewer bits; 17 digits always read back.
    few = F.filter(
        F.array(*[F.format_string(f"%.{digits}e", number) for digits in range(15)]), lambda t: t.cast("double") == number
    )
    fifteen, sixteen = F.format_string("%.14e", number), F.format_string("%.15e", number)
    text = (
        F.when((magnitude < SMALLEST_WHOLE) & (F.size(few) > 0), F.get(few, F.lit(0)))
        .when(fifteen.cast("double") == number, fifteen)
        .when(sixteen.cast("double") == number, sixteen)
        .otherwise(F.format_string("%.16e", number))
    )
    mantissa = F.regexp_replace(F.substring_index(text, "e", 1), r"\.?0+$", "")
    power = F.substring_index(text, "e", -1).cast("int")
    exponent = F.concat(mantissa, F.when(power > 0, "e+").otherwise("e"), power)

    def plain(scale: int) -> Column:
        return F.regexp_replace(text.cast(f"decimal(38,{scale})").cast("string"), r"\.?0+$", "")

    return (
        F.when(number == 0, F.lit("0"))
        .when((magnitude >= 1e21) | (magnitude < 1e-6), exponent)
        .when(magnitude >= 1, plain(16))
        .otherwise(plain(24))
    )


def scalar_text(text: Column, kind: Column) -> Column:
    """Text of a JSON scalar of this kind from its plain one; NULL for arrays and objects."""
    number = text.try_cast("double")
    # Up to 15 significant digits a decimal prints like the double it stands for.
    short_decimal = kind.startswith("DECIMAL") & (F.length(text) <= 15) & (F.abs(number) >= 1e-6)
    return (
        F.when(kind.isin("STRING", "BOOLEAN"), text)
        .when(kind == "VOID", F.lit("null"))
        .when((kind == "BIGINT") & (F.abs(number) < MAX_SAFE_INTEGER), text)
        .when(short_decimal, text)
        .when(kind.startswith("DECIMAL") | kind.isin("BIGINT", "DOUBLE"), js_number_text(number))
    )


def canonical_numbers(json: Column) -> Column:
    """JSON text with every number outside strings in its shortest form."""
    tokens = F.regexp_extract_all(json, F.lit(f"(?s){_TOKEN}"), F.lit(0))
    shortest = F.transform(
        tokens, lambda t: F.when(F.rlike(t, F.lit(f"^{_NUMBER}$")), js_number_text(t.try_cast("double"))).otherwise(t)
    )
    return F.when(F.rlike(json, F.lit(_ODD_NUMBER)), F.array_join(shortest, "")).otherwise(json)


def text_to_boolean(text: Column) -> Column:
    """``true/1/yes`` and ``false/0/no`` in any case; NULL for anything else."""
    word = F.lower(js_trim(text))
    return F.when(word.isin("true", "1", "yes"), F.lit(True)).when(word.isin("false", "0", "no"), F.lit(False))
