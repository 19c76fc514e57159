"""Column expressions for paper ids, DOIs, arXiv and PubMed ids, titles and names.

Nulls give null unless a docstring says otherwise. Patterns and prefixes are fixed values of the formats.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = {"semantic_scholar": "s2", "openalex": "openalex", "pubmed": "pmid", "arxiv": "arxiv"}
DOI_PREFIXES = r"^(?:(?:https?://)?(?:dx\.|www\.)?doi\.org/|doi:)+"
ARXIV_PREFIXES = r"^(?:(?:https?://)?(?:www\.)?arxiv\.org/(?:abs|pdf)/|arxiv:)+"
STOP_WORDS = ("a", "an", "the", "of", "for", "and", "in", "on", "to", "with", "by", "from")
DOI_IN_TEXT = r"(?i)10\.\d{4,9}/[^\s,;)\]}<>\"']+"
ARXIV_IN_TEXT = r"(?i)(?:arxiv[:/\s]*|abs/)(\d{4}\.\d{4,5}|[a-z-]+(?:\.[a-z-]+)?/\d{7})(?:v\d+)?"
PMID_IN_TEXT = r"(?i)(?:pmid[:\s]*)(\d{1,9})"


def _lookup(c: Column, table: dict[str, str]) -> Column:
    out = F.lit(None).cast("string")
    for k, v in table.items():
        out = F.when(c == k, v).otherwise(out)
    return F.coalesce(out, c)


def normalize_id(provider: Column, native: Column) -> Column:
    """prefix:native; a native id that has the prefix already, in any case, keeps one."""
    prefix = _lookup(provider, PREFIX)
    head = F.substring_index(native, ":", 1)
    doubled = F.contains(native, F.lit(":")) & (F.lower(head) == F.lower(prefix))
    return F.concat(prefix, F.lit(":"), F.when(doubled, F.substr(native, F.char_length(head) + 2)).otherwise(native))


def parse_normalized_id(nid: Column) -> Column:
    """struct(provider, native); an unknown prefix stands for itself, an id without a colon has an empty native part."""
    head = F.substring_index(nid, ":", 1)
    return F.struct(_lookup(head, {v: k for k, v in PREFIX.items()}).alias("provider"), F.substr(nid, F.char_length(head) + 2).alias("native"))


def _bare(c: Column, prefixes: str) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"\s+", "")), prefixes, "")


def normalize_doi(c: Column) -> Column:
    return _bare(c, DOI_PREFIXES)


def is_valid_doi(c: Column) -> Column:
    return c.rlike(r"^10\.\d{4,9}/\S+$")


def normalize_arxiv(c: Column) -> Column:
    return F.regexp_replace(_bare(c, ARXIV_PREFIXES), r"v\d+$", "")


def is_valid_arxiv(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)v\d+$", "").rlike(r"^(?:\d{4}\.\d{4,5}|[a-z-]+(?:\.[a-z-]+)?/\d{7})$")


def normalize_pmid(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(c, r"\s+", "")), "^pmid:", "")


def is_valid_pmid(c: Column) -> Column:
    return c.rlike(r"^\d{1,9}$")


def alias_key(kind: str, c: Column) -> Column:
    """doi:, arxiv: or pmid: and the normal form; null if that is not valid."""
    normal, valid = {"doi": (normalize_doi, is_valid_doi), "arxiv": (normalize_arxiv, is_valid_arxiv), "pmid": (normalize_pmid, is_valid_pmid)}[kind]
    return F.when(valid(normal(c)), F.concat(F.lit(f"{kind}:"), normal(c)))


def alias_keys(doi: Column, arxiv: Column, pmid: Column) -> Column:
    """The valid keys, in that order."""
    return F.array_compact(F.array(alias_key("doi", doi), alias_key("arxiv", arxiv), alias_key("pmid", pmid)))


def normalize_title(c: Column) -> Column:
    """Lower case with ss for sharp s; runs of other characters than letters, digits, marks and _ become one space."""
    return F.trim(F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{M}\p{N}_]+", " "))


def title_tokens(c: Column) -> Column:
    """Distinct words of the normal title without stop words."""
    words = F.filter(F.split(normalize_title(c), " "), lambda x: x != "")
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOP_WORDS]))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Intersection over union of two arrays as sets; `empty` where both are empty, 0 where one is."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def words(c: Column) -> Column:
    """Distinct lower-cased runs of letters, digits and _."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}_]+"), lambda x: x != ""))


def titles_match(a: Column, b: Column, least: float = 0.3) -> Column:
    """Whether the titles' words are alike; true when either has none."""
    x, y = words(F.coalesce(a, F.lit(""))), words(F.coalesce(b, F.lit("")))
    return (F.size(x) == 0) | (F.size(y) == 0) | (jaccard(x, y) >= least)


def surname(c: Column) -> Column:
    """The last word before the first comma, without punctuation, lower case; empty if there is none."""
    parts = F.split(F.trim(F.substring_index(F.trim(c), ",", 1)), r"\s+")
    return F.lower(F.regexp_replace(F.element_at(parts, -1), r"[^\p{L}\p{M}\p{N}_\s]+", ""))


def author_overlap(expected: Column, actual: Column) -> Column:
    """Share of the expected surnames that are among the actual; 0 if either side has none."""
    clean = lambda a: F.array_distinct(F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), surname), lambda x: x != ""))
    a, b = clean(expected), clean(actual)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1)))


def year_matches(a: Column, b: Column, tolerance: int = 2) -> Column:
    return F.coalesce(F.abs(a - b) <= tolerance, F.lit(True))


def dedup_key(doi: Column, arxiv: Column, title: Column, authors: Column, year: Column, provider: Column, native: Column) -> Column:
    """DOI key (as it is, if malformed), else a valid arXiv key, else the id without a title, else title, least surname and year."""
    filled = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    least = F.coalesce(F.array_min(F.filter(F.transform(authors, surname), lambda x: x != "")), F.lit(""))
    named = F.concat(F.lit("title:"), normalize_title(title), F.lit(":"), least, F.lit(":"), F.coalesce(year.cast("string"), F.lit("")))
    return F.coalesce(F.concat(F.lit("doi:"), normalize_doi(filled(doi))), alias_key("arxiv", filled(arxiv)), F.when(filled(title).isNull(), normalize_id(provider, native)), named)


def completeness(title: Column, doi: Column, arxiv: Column, year: Column, authors: Column, abstract: Column) -> Column:
    """How many of six kinds of metadata are there."""
    text = lambda c: (F.coalesce(c, F.lit("")) != "").cast("int")
    return text(title) + text(doi) + text(arxiv) + year.isNotNull().cast("int") + (F.coalesce(F.size(authors), F.lit(0)) > 0).cast("int") + text(abstract)


def detect_seed(raw: Column) -> Column:
    """struct(kind, value, fetch_value): a DOI, an arXiv id or the source's own id; fetch_value is what a source is asked for, for an arXiv id
    without address, prefix and .pdf but with its version."""
    raw = F.trim(raw)
    fetch = F.regexp_replace(F.regexp_replace(F.regexp_replace(raw, r"\s+", ""), r"(?i)^((https?://)?(www\.)?arxiv\.org/(abs|pdf)/|arxiv:)", ""), r"\.pdf$", "")
    doi, arxiv = normalize_doi(raw), normalize_arxiv(fetch)
    kind = F.when(is_valid_doi(doi), "doi").when(is_valid_arxiv(arxiv), "arxiv").otherwise("native")
    pick = lambda a: F.when(kind == "doi", doi).when(kind == "arxiv", a).otherwise(raw)
    return F.struct(kind.alias("kind"), pick(arxiv).alias("value"), pick(fetch).alias("fetch_value"))


def extract_doi(c: Column) -> Column:
    return F.transform(F.regexp_extract_all(c, F.lit(DOI_IN_TEXT), F.lit(0)), lambda x: F.regexp_replace(x, "[.,;]+$", ""))


def extract_arxiv(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(ARXIV_IN_TEXT), F.lit(1))


def extract_pmid(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(PMID_IN_TEXT), F.lit(1))


def lookup_key(target: Column, origin: Column, native: Column, doi: Column, arxiv: Column) -> Column:
    """The key under which a source is asked for a paper: its own id, else one made of DOI or arXiv id, else null."""
    return (
        F.when(target == origin, native)
        .when((target == "semantic_scholar") & doi.isNotNull(), F.concat(F.lit("DOI:"), doi))
        .when((target == "semantic_scholar") & arxiv.isNotNull(), F.concat(F.lit("arXiv:"), arxiv))
        .when((target == "openalex") & doi.isNotNull(), doi)
        .when((target == "openalex") & arxiv.isNotNull(), F.concat(F.lit("10.48550/arxiv."), arxiv))
    )
