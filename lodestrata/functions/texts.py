"""Column expressions for cleaning, hashing and redacting text."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names whose values are secret.
SENSITIVE = r"(?:x-api-key|api[_-]?key|apikey|access[_-]?token|auth[_-]?token|authorization|token|email|password|secret|key)"
SECRET = rf"(?i)([?&;\"'\s=:,{{]|^)({SENSITIVE})(\s*[\"']?\s*[:=]\s*[\"']?)((?:(?:bearer|basic|token|digest)\s+)?[^&\s,;\"'}}\]]+)"


def collapse(c: Column) -> Column:
    """White space as single spaces, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def trim_entry(c: Column, most: int = 2000) -> Column:
    return F.left(collapse(c), F.lit(most))


def excerpt(c: Column, most: int = 240) -> Column:
    return F.left(collapse(c), F.lit(most))


def sha256_text(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def raw_entry_hash(c: Column) -> Column:
    return sha256_text(collapse(c))


def source_hash(entries: Column) -> Column:
    return sha256_text(F.array_join(entries, "\n---\n"))


def stable_id(prefix: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.left(sha256_text(F.concat_ws("|", *parts)), F.lit(16)))


def provisional_id(source: Column, entry: Column) -> Column:
    return F.concat(F.lit("bib:"), F.left(source, F.lit(16)), F.lit(":"), F.left(entry, F.lit(16)))


def normal_claim(c: Column) -> Column:
    return F.lower(collapse(c))


def redact_secrets(c: Column) -> Column:
    """Values after a sensitive name and : or = become ***."""
    return F.regexp_replace(c, SECRET, r"$1$2$3***")


def redact_json(payload: Column) -> Column:
    """JSON of any depth: what stands under a sensitive key becomes "***" whatever it is, other strings lose their secrets.
    Keys keep their order; a text that is no JSON is redacted as text; null is null. In Arrow batches."""

    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        key, secret = re.compile(SENSITIVE, re.I), re.compile(SECRET)
        plain = lambda s: secret.sub(lambda m: f"{m[1]}{m[2]}{m[3]}***", s)

        def clean(v):
            if isinstance(v, dict):
                return {k: "***" if key.fullmatch(k) else clean(w) for k, w in v.items()}
            return [clean(w) for w in v] if isinstance(v, list) else plain(v) if isinstance(v, str) else v

        def one(s):
            if s is None or s != s:
                return None
            try:
                return json.dumps(clean(json.loads(s)), ensure_ascii=False, separators=(",", ":"))
            except (ValueError, RecursionError):
                return plain(s)

        return x.map(one)

    return run(payload)


def canonical_json(fields: dict[str, Column]) -> Column:
    """A compact JSON object of the fields by sorted name; nulls are written. The values' own order is that of their types."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def state_hash(fields: dict[str, Column]) -> Column:
    return sha256_text(canonical_json(fields))


def normal_query(c: Column) -> Column:
    """A search text without case and with single spaces."""
    return F.lower(collapse(c))


def mapping_job_id(*parts: Column) -> Column:
    return F.left(sha256_text(F.concat_ws("|", *parts)), F.lit(24))


def as_list(c: Column) -> Column:
    """A loose JSON value as a list of trimmed texts: an array's entries, a string or number by itself, null as none; no empty ones."""
    kind = F.schema_of_variant(c)
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get(c, "$", "array<string>"))
    one = F.array(F.try_variant_get(c, "$", "string"))
    found = F.when(c.isNull() | F.is_variant_null(c), F.array().cast("array<string>")).otherwise(F.coalesce(items, one))
    return F.filter(F.transform(found, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")


def as_text(c: Column) -> Column:
    """A loose JSON value as one text: the entries of `as_list` with a space between."""
    return F.array_join(as_list(c), " ")


def pick(c: Column, *names: str) -> Column:
    """The first of a JSON object's values under the names that isn't null or empty."""
    full = lambda n: F.when(~F.coalesce(F.try_variant_get(c, f"$.{n}", "string"), F.lit("")).isin("", "[]", "{}", "null"), F.try_variant_get(c, f"$.{n}", "variant"))
    return F.coalesce(*[full(n) for n in names])


def narrative(c: Column, fallback: str = "") -> Column:
    """A model's story from JSON text: a string as it is; an object as paragraphs **name**: value by name, without nulls; a list
    as bullets, of an object its title or name; the fallback if nothing is left or it is no JSON."""
    v = F.try_parse_json(c)
    kind = F.coalesce(F.schema_of_variant(v), F.lit(""))
    names = F.array_sort(F.json_object_keys(c))
    value = lambda n: F.call_function("get_json_object", c, F.concat(F.lit("$."), n))
    fields = F.filter(F.transform(names, lambda n: F.concat(F.lit("**"), n, F.lit("**: "), value(n))), lambda x: x.isNotNull())
    entries = F.try_variant_get(v, "$", "array<variant>")
    bullet = lambda x: F.concat(F.lit("- "), F.when(F.schema_of_variant(x).startswith("OBJECT"), F.coalesce(F.try_variant_get(x, "$.title", "string"), F.try_variant_get(x, "$.name", "string"), F.to_json(x))).otherwise(F.try_variant_get(x, "$", "string")))
    text = F.when(kind == "STRING", F.try_variant_get(v, "$", "string")).when(kind.startswith("OBJECT"), F.array_join(fields, "\n\n")).when(kind.startswith("ARRAY"), F.array_join(F.transform(entries, bullet), "\n"))
    return F.when(F.coalesce(text, F.lit("")) != "", text).otherwise(fallback)


def evidence_setting(fields: Column, provider: Column) -> Column:
    """The first field of study, else the provider."""
    return F.coalesce(F.get(fields, F.lit(0)), provider)


def content_kind(fulltext: Column, abstract: Column) -> Column:
    filled = lambda c: F.coalesce(F.length(F.trim(c)) > 0, F.lit(False))
    return F.when(filled(fulltext), "full_text").when(filled(abstract), "abstract").otherwise("metadata")


def approx_tokens(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.char_length(c) / 4)).cast("long")


def safe_filename(c: Column) -> Column:
    """The name with separators and controls as _; null if it has .. or an empty last part."""
    bad = F.contains(c, F.lit("..")) | (F.trim(F.element_at(F.split(c, r"[/\\]"), -1)) == "")
    return F.when(~bad, F.regexp_replace(c, r"[/\\\x00-\x1f]", "_"))


def scope(title: Column, year: Column, abstract: Column, query: Column, most: int = 40) -> Column:
    """struct(text, origin): the user's words if there are any, else title, year and the abstract's start; capped in words."""
    derived = collapse(F.concat_ws(" ", title, year.cast("string"), abstract))
    own = F.length(F.trim(F.coalesce(query, F.lit("")))) > 0
    text = F.when(own, collapse(query)).otherwise(derived)
    return F.struct(F.array_join(F.slice(F.split(text, " "), F.lit(1), F.lit(most)), " ").alias("text"), F.when(own, "user").otherwise("derived").alias("origin"))


def html_to_text(c: Column, most: int) -> Column:
    """Head, scripts, styles and tags dropped, white space collapsed, cut at `most` characters."""
    bare = F.regexp_replace(c, r"(?is)<head[^>]*>.*?</head>", " ")
    bare = F.regexp_replace(bare, r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " ")
    return F.left(collapse(F.regexp_replace(bare, r"(?s)<[^>]+>", " ")), F.lit(most))


def parse_model_json(c: Column, schema: str) -> Column:
    """A model's answer as a struct: without code fence, the whole text or what lies between the first { and the last }."""
    bare = F.trim(F.regexp_replace(F.trim(c), r"^```[A-Za-z]*\s*|\s*```$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    return F.when(F.coalesce(F.try_parse_json(bare), F.try_parse_json(inner)).isNotNull(), F.from_json(F.when(F.try_parse_json(bare).isNotNull() & bare.startswith("{"), bare).otherwise(inner), schema))
