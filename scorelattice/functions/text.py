"""Text predicates and normalisers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T
from pyspark.sql.functions import pandas_udf

# Accepted spellings and closed lists.
LOOSE_NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
STRICT_DECIMAL = r"^[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?$"
HEX_SHA256 = r"^[0-9a-f]{64}$"
STABLE_ID = r"^[a-z0-9][a-z0-9._-]{0,127}$"
REASON_CODE = r"^[A-Z][A-Z0-9_]{2,127}$"
ZERO_WIDTH = r"[\u200b-\u200f\u2060\ufeff\u00ad]"
CREDENTIAL_QUERY_KEYS = (
    "access_token", "api_key", "apikey", "credential", "password", "secret",
    "signature", "token", "x-amz-credential", "x-amz-signature",
    "x-goog-credential", "x-goog-signature",
)


def alias_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def alias_key_unicode(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


def loose_number(text: Column) -> Column:
    """First number in a text once ``%`` and ``,`` are gone."""
    bare = F.translate(F.trim(text), "%,", "")
    return F.regexp_extract(bare, LOOSE_NUMBER, 0).try_cast("double")


def strict_number_error(lexeme: Column, policy: Column) -> Column:
    """Why a score lexeme is no exact finite number, or null when it is one.

    ``policy`` is ``decimal`` or ``decimal_percent``.
    """
    has_percent = lexeme.endswith("%")
    wants_percent = policy == "decimal_percent"
    bare = strict_number_text(lexeme, policy)
    value = bare.try_cast("double")
    mantissa = F.regexp_extract(bare, r"^[+-]?([0-9.]*)", 1)
    return F.coalesce(
        F.when(has_percent != wants_percent, "SCORE_UNIT_UNDECLARED"),
        F.when(~bare.rlike(STRICT_DECIMAL), "SCORE_NOT_NUMERIC"),
        F.when(F.abs(value) == float("inf"), "SCORE_NOT_FINITE"),
        F.when((value == 0) & mantissa.rlike("[1-9]"), "SCORE_NOT_REPRESENTABLE"),
    )


def strict_number_text(lexeme: Column, policy: Column) -> Column:
    return F.when(
        policy == "decimal_percent", F.regexp_replace(lexeme, "%$", "")
    ).otherwise(lexeme)


def strict_number(lexeme: Column, policy: Column) -> Column:
    return F.when(
        strict_number_error(lexeme, policy).isNull(),
        strict_number_text(lexeme, policy).try_cast("double"),
    )


def is_json(document: Column) -> Column:
    """Whether the text is a JSON document; repeated keys are allowed."""
    return F.get_json_object(document, "$").isNotNull()


def has_duplicate_keys(document: Column) -> Column:
    """Whether an object at any level repeats a key; null for text that is no JSON.

    The variant parser accepts all JSON but that.
    """
    return F.when(is_json(document), F.try_parse_json(document).isNull())


def fold_header(text: Column) -> Column:
    """Header text without invisible marks and with single spaces."""
    visible = F.translate(F.regexp_replace(text, ZERO_WIDTH, ""), "\u00a0", " ")
    return F.trim(F.regexp_replace(visible, r"\s+", " "))


@pandas_udf(T.StringType())
def _escape_invisible(texts: pd.Series) -> pd.Series:
    short = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t", "\\": "\\\\"}

    def shown(ch: str) -> str:
        if ch in short:
            return short[ch]
        if ch.isascii() and ch.isprintable():
            return ch
        if unicodedata.category(ch) not in ("Cc", "Cf"):
            return ch
        width = 2 if ord(ch) < 0x100 else 4 if ord(ch) < 0x10000 else 8
        return "\\" + {2: "x", 4: "u", 8: "U"}[width] + format(ord(ch), f"0{width}x")

    return texts.map(lambda t: None if t is None else "".join(map(shown, t)))


def visible_text(text: Column) -> Column:
    """Control and format characters spelled out.

    Texts without any (nearly all) never leave the JVM: only the others are
    handed to Python.
    """
    needs_python = text.rlike(r"[\p{Cc}\p{Cf}]")
    plain = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    escaped = _escape_invisible(F.when(needs_python, text))
    return F.concat(F.lit("text:"), F.when(needs_python, escaped).otherwise(plain))


def is_sha256(text: Column) -> Column:
    return text.rlike(HEX_SHA256)


def is_stable_id(text: Column) -> Column:
    return text.rlike(STABLE_ID)


def is_reason_code(text: Column) -> Column:
    return text.rlike(REASON_CODE)


def is_public_https_url(url: Column) -> Column:
    """https with a host, and no login, fragment, control character or secret key."""
    query = F.coalesce(F.try_parse_url(url, F.lit("QUERY")), F.lit(""))
    # A key counts as it reads when decoded; one that cannot be decoded is refused.
    keys = F.transform(F.split(query, "&"), lambda pair: F.lower(F.try_url_decode(F.split(pair, "=")[0])))
    secrets = F.array(*[F.lit(k) for k in CREDENTIAL_QUERY_KEYS])
    return F.coalesce(
        (F.try_parse_url(url, F.lit("PROTOCOL")) == "https")
        & (F.length(F.try_parse_url(url, F.lit("HOST"))) > 0)
        & F.try_parse_url(url, F.lit("USERINFO")).isNull()
        & ~url.contains("#")
        & ~url.rlike(r"[\x00-\x1f\x7f]")
        & ~F.exists(keys, lambda key: key.isNull())
        & ~F.arrays_overlap(keys, secrets),
        F.lit(False),
    )


def _cursor(body: Column) -> Column:
    token = F.base64(F.encode(body, "UTF-8"))
    for old, new in (("+", "-"), ("/", "_"), ("=", ""), ("\r\n", "")):
        token = F.replace(token, F.lit(old), F.lit(new))
    return F.concat(F.lit("v1."), token)


def visible_cursor(created: Column, row_id: Column) -> Column:
    """Opaque page token: ``v1.`` and base64url of the canonical two-key object."""
    return _cursor(F.to_json(F.struct(created.alias("created_at"), row_id.alias("id"))))


#: A canonical object whose values need no escapes.
_PLAIN_CURSOR = r'\A\{"created_at":"([ !#-\[\]-~]*+)","id":"([ !#-\[\]-~]*+)"\}\z'


def cursor_fields(token: Column) -> Column:
    """``struct(created_at, id)`` of a token, null unless it is in exact form.

    Every canonical object begins and ends alike, so no other text is parsed; one
    whose values need no escapes is its own spelling.
    """
    urlsafe = F.regexp_extract(token, r"^v1\.([A-Za-z0-9_-]+)$", 1)
    body = F.replace(F.replace(urlsafe, F.lit("-"), F.lit("+")), F.lit("_"), F.lit("/"))
    # One character over a multiple of four is never base64; Spark would throw and catch for each such row.
    whole = F.when(F.length(body) % 4 != 1, body)
    padded = F.rpad(whole, (F.ceil(F.length(whole) / 4) * 4).cast("int"), F.lit("="))
    raw = F.try_to_binary(padded, F.lit("base64")).cast("string")
    # Bound to a name, so that what is decoded once is not decoded for each mention.
    return F.get(F.transform(F.array(raw), lambda r: _fields_of(r, token)), F.lit(0))


def _fields_of(raw: Column, token: Column) -> Column:
    values = [F.regexp_extract(raw, _PLAIN_CURSOR, i).alias(f) for i, f in enumerate(("created_at", "id"), 1)]
    shaped = F.when(raw.startswith('{"created_at":"') & raw.endswith('"}'), raw)
    parsed = F.from_json(shaped, "created_at string, id string")
    # Spelled with defaults, as a bare rebuilt struct would fold back to a null one.
    again = visible_cursor(*[F.coalesce(parsed[f], F.lit("")) for f in ("created_at", "id")])
    plain = F.when(_cursor(raw) == token, F.struct(*values))
    return F.when(raw.rlike(_PLAIN_CURSOR), plain).when(shaped.isNotNull(), F.when(again == token, parsed))
