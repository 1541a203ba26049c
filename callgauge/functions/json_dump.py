"""JSON text in the form of Python's ``json.dumps``, rewritten token by token in column expressions.

The form: a blank after each comma and colon, keys in the order they were sent, ``\\uXXXX`` for all but printable ASCII, and
numbers with a point or an exponent as Python writes them. No Python worker runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A string (its end may be cut off), a separator, or brackets with what stands between them.
_TOKEN = r'"(?:[^"\\]++|\\[^\n])*+(?:"|\\?\z)|[,:]|[^",:]++'
#: Of a string: an escape with digits, another escape, printable ASCII, anything else.
_PIECE = r"\\u[0-9A-Fa-f]{4}|\\[^\n]|[\x20-\x5b\x5d-\x7e]++|[^\x20-\x7e]++|\\"
_FLOAT = r"-?[0-9]++(?:\.[0-9]++)?(?:E[+-]?[0-9]++)?"


def _escaped(string: Column) -> Column:
    def piece(p: Column) -> Column:
        units = F.lower(F.hex(F.encode(p, "UTF-16BE")))
        return F.when(p.rlike(r"^\\u"), F.lower(p)).when(p.rlike(r"^[\x20-\x7e]"), p).otherwise(F.regexp_replace(units, "(.{4})", r"\\u$1"))

    pieces = F.transform(F.regexp_extract_all(string, F.lit(_PIECE), F.lit(0)), piece)
    return F.when(string.rlike(r"[^\x20-\x7e]|\\u"), F.array_join(pieces, "")).otherwise(string)


def _number(text: Column) -> Column:
    """A number with a point as Python writes it: the fewest digits that read back as the same double; positional from 1e-4 to below 1e16."""
    value = text.try_cast("double")
    shorter = [F.format_string(f"%.{n}E", value) for n in (14, 15)]  # Java alone may write one digit too many
    written = F.coalesce(*(F.when(s.try_cast("double") == value, s) for s in shorter), F.format_string("%.16E", value))
    exponent = F.regexp_extract(written, "E(.*)$", 1).try_cast("int")
    mantissa = F.regexp_replace(F.regexp_extract(written, "^([^E]*)", 1), r"\.?0*$", "")
    scientific = F.concat(mantissa, F.lit("e"), F.regexp_extract(written, "E(.*)$", 1))
    plain = F.regexp_replace(F.regexp_replace(written.try_cast("decimal(38,21)").cast("string"), "0+$", ""), r"\.$", ".0")
    return F.when(value == 0, text).when(exponent.between(-4, 15), plain).otherwise(scientific)


def _rewritten(token: Column) -> Column:
    parts = [F.regexp_extract(token, f"^([\\[{{\\]}}]*)({_FLOAT})(.*)$", i) for i in (1, 2, 3)]
    number = F.when(token.rlike("[0-9][.E]"), F.concat(parts[0], _number(parts[1]), parts[2])).otherwise(token)
    return F.when(token.isin(",", ":"), F.concat(token, F.lit(" "))).when(token.startswith('"'), _escaped(token)).otherwise(number)


def python_dump(compact: Column, cap: int) -> Column:
    """The first ``cap`` characters of ``json.dumps`` of a value given as compact JSON text.

    No token gets shorter by more than a sixth, so twice the cap of the text is enough to read, however long it is.
    """
    tokens = F.regexp_extract_all(F.left(compact, F.lit(2 * cap)), F.lit(_TOKEN), F.lit(0))
    return F.left(F.array_join(F.transform(tokens, _rewritten), ""), F.lit(cap))


def dumped_member(body: Column, name: str, value: Column, cap: int) -> Column:
    """``python_dump`` of an object's member; ``value``: the same member as a variant.

    Of a repeated key the first counts. A number beyond the range of doubles becomes a string.
    """
    found = F.get_json_object(body, f"$.{name}")
    quoted = F.to_json(F.array(F.left(found, F.lit(2 * cap))))
    of_string = F.substr(quoted, F.lit(2), F.length(quoted) - 2)
    return python_dump(F.when(F.schema_of_variant(value) == "STRING", of_string).otherwise(found), cap)
