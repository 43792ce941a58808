"""Column expressions that many operators share. All are pure; the clock is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How reliable a link's source is.
SOURCE_RELIABILITY = {"manual": 1.0, "wikilink": 1.0, "dialogue": 0.7, "agent": 0.7, "writeback": 0.5, "unknown": 0.5, "ner": 0.3, "auto": 0.3}
DEFAULT_RELIABILITY = 0.3


def active_link(trust: Column | str = "trust_state") -> Column:
    c = F.col(trust) if isinstance(trust, str) else trust
    return ~F.coalesce(c, F.lit("")).isin("rejected", "superseded")


def current_fact(trust: Column | str = "trust_state", relation: Column | str = "relation") -> Column:
    """Active, and no mere candidate for a manager edge. Null-safe: an edge without trust state counts as a fact."""
    t = F.col(trust) if isinstance(trust, str) else trust
    r = F.col(relation) if isinstance(relation, str) else relation
    return active_link(t) & ~((r == "reports_to") & t.eqNullSafe(F.lit("candidate")))


def entity_or_concept(kind: str = "type") -> Column:
    return F.col(kind).startswith("entity/") | F.col(kind).startswith("concept/")


def type_rank(kind: str = "type") -> Column:
    return F.when(F.col(kind).startswith("entity/"), 0).when(F.col(kind).startswith("concept/"), 1).otherwise(2)


def reliability(source: str = "source_type") -> Column:
    out = None
    for name, value in SOURCE_RELIABILITY.items():
        hit = F.col(source) == name
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(DEFAULT_RELIABILITY)


def trust_from_source(source: str = "source_type", confidence: str = "confidence") -> Column:
    return F.when(F.col(confidence) < 0.3, "candidate").when(F.col(source).isin("wikilink", "manual"), "trusted").otherwise("candidate")


def valid_date(c: str = "event_date") -> Column:
    """YYYY, YYYY-MM or YYYY-MM-DD (proleptic Gregorian, years from 1)."""
    t = F.trim(F.col(c))
    padded = F.when(F.length(t) == 4, F.concat(t, F.lit("-01-01"))).when(F.length(t) == 7, F.concat(t, F.lit("-01"))).otherwise(t)
    shape = t.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$") & (F.substring(t, 1, 4) != "0000")
    return F.coalesce(shape & F.try_to_date(padded, "yyyy-MM-dd").isNotNull(), F.lit(False))


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(8.64e10)


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def half_up(c: Column, digits: int = 3) -> Column:
    """Round half up, as Math.round does: floor(x * 10^d + 1/2) / 10^d."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / scale


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def finite(a: Column) -> Column:
    return F.forall(a, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))


def cosine(a: Column, b: Column) -> Column:
    """Scaled cosine: null on unequal lengths, non-finite values or a zero vector; else within [-1, 1]."""
    ok = (F.size(a) == F.size(b)) & finite(a) & finite(b) & (norm(a) > 0) & (norm(b) > 0)
    return F.when(ok, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / (norm(a) * norm(b)))))


def plain_cosine(a: Column, b: Column) -> Column:
    """The cosine, 0 where there is none."""
    return F.coalesce(cosine(a, b), F.lit(0.0))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda s, x: s + x)


def normal_name(c: Column) -> Column:
    """Lower case without separators, parentheticals and anything but letters and digits."""
    out = F.regexp_replace(F.lower(c), r"[\s\-_.]+", "")
    out = F.regexp_replace(out, r"[（(].+?[）)]", "")
    return F.regexp_replace(out, r"[^\p{L}\p{N}]", "")


def hash32(c: Column, part: int = 0) -> Column:
    """32 bits of a text's MD5, as a long: sums of them name a set without gathering it."""
    return F.conv(F.substring(F.md5(c), 1 + 8 * part, 8), 16, 10).cast("long")


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))
