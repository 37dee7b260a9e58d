"""Scalar expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms that are no part of a company's name.
LEGAL_FORMS = ["the", "inc", "incorporated", "corp", "corporation", "co", "company", "companies", "ltd", "limited", "plc", "llc", "lp", "sa", "nv", "ag", "holding", "holdings", "group", "trust", "class", "common", "stock", "new"]


def direction(value: Column) -> Column:
    return F.when(value > 0, "long").when(value < 0, "short").otherwise("flat")


def sign_of(direction_: Column) -> Column:
    return F.when(direction_ == "long", F.lit(1.0)).when(direction_ == "short", F.lit(-1.0)).otherwise(F.lit(0.0))


def vol_scale(sigma: Column, target: float, max_scale: float, ppy: int) -> Column:
    """min(max_scale, target / (sigma * sqrt(ppy))); null without a positive sigma."""
    return F.when(sigma > 0, F.least(F.lit(float(max_scale)), F.lit(float(target)) / (sigma * F.sqrt(F.lit(float(ppy))))))


def holding_bucket(days: Column) -> Column:
    return F.when(days <= 7, "1-7d").when(days <= 30, "8-30d").when(days <= 90, "31-90d").when(days <= 365, "91-365d").otherwise("366d+")


def calendar_days(sessions: Column, every_day: bool) -> Column:
    return sessions if every_day else (F.ceil(sessions * F.lit(1.5)) + 10).cast("int")


def normalise_ticker(s: Column) -> Column:
    return F.regexp_replace(F.translate(F.upper(F.trim(s)), ".", "-"), "[^A-Z0-9-]", "")


def name_tokens(s: Column) -> Column:
    words = F.array_distinct(F.regexp_extract_all(F.lower(s), F.lit("[a-z0-9]+"), F.lit(0)))
    return F.array_except(words, F.array(*[F.lit(x) for x in LEGAL_FORMS]))


def name_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the names' words; 0 when either has none."""
    x, y = name_tokens(a), name_tokens(b)
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), both / F.size(F.array_union(x, y))).otherwise(F.lit(0.0))


def parse_date(text: Column) -> Column:
    """A date written as "January 2, 2000", "Jan 2, 2000" or starting with 2000-01-02; null for any other text."""
    t = F.trim(F.regexp_replace(text, "\\s+", " "))
    tries = [F.try_to_timestamp(t, F.lit(f)) for f in ("MMMM d, yyyy", "MMM d, yyyy")]
    return F.to_date(F.coalesce(*tries, F.try_to_timestamp(F.substring(t, 1, 10), F.lit("yyyy-MM-dd"))))


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone, read as UTC whatever the session's zone is."""
    clock = (F.hour(ts) * 3600 + F.minute(ts) * 60).cast("long") * 1_000_000
    return F.unix_date(F.to_date(ts)).cast("long") * 86_400_000_000 + clock + (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def half_life(slope: Column) -> Column:
    """Of a mean-reverting residual whose changes regress on its level with ``slope``; null unless -1 < slope < 0."""
    return F.when((slope > -1) & (slope < 0), -F.ln(F.lit(2.0)) / F.ln(1 + F.when((slope > -1) & (slope < 0), slope)))


def once(x: Column, f) -> Column:
    """``f(x)`` with ``x`` computed once, for an ``f`` that names its argument many times."""
    return F.element_at(F.transform(F.array(x), f), 1)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function by the Zelen-Severo polynomial's successor with |error| < 1e-15 (Hart's rational form)."""
    # Coefficients of Hart's approximation as published by West (2005).
    top = (0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
    low = (0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
    z = F.abs(x)
    num, den = F.lit(top[0]), F.lit(low[0])
    for c in top[1:]:
        num = num * z + c
    for c in low[1:]:
        den = den * z + c
    e = F.exp(-z * z / 2)
    tail_frac = z + 1 / (z + 2 / (z + 3 / (z + 4 / (z + 0.65))))
    tail = F.when(z < 7.07106781186547, e * num / den).when(z < 37, e / tail_frac / 2.506628274631).otherwise(F.lit(0.0))
    return F.when(x > 0, 1 - tail).otherwise(tail)


def _ratio(x: Column, top: tuple[float, ...], low: tuple[float, ...]) -> Column:
    num, den = F.lit(top[-1]), F.lit(low[-1])
    for c in top[-2::-1]:
        num = num * x + c
    for c in low[-2::-1]:
        den = den * x + c
    return num / den


def normal_quantile(p: Column) -> Column:
    """Inverse of the standard normal distribution function (Wichura's rational form, error near 1e-16); null outside (0, 1)."""
    # Coefficients of algorithm AS 241 (Wichura 1988), from the constant term up: middle, near tail, far tail.
    middle = (
        (3.3871328727963666080, 133.14166789178437745, 1971.5909503065514427, 13731.693765509461125, 45921.953931549871457, 67265.770927008700853, 33430.575583588128105, 2509.0809287301226727),
        (1.0, 42.313330701600911252, 687.18700749205790830, 5394.1960214247511077, 21213.794301586595867, 39307.895800092710610, 28729.085735721942674, 5226.4952788528545610),
    )
    near = (
        (1.42343711074968357734, 4.63033784615654529590, 5.76949722146069140550, 3.64784832476320460504, 1.27045825245236838258, 0.241780725177450611770, 0.0227238449892691845833, 7.74545014278341407640e-4),
        (1.0, 2.05319162663775882187, 1.67638483018380384940, 0.689767334985100004550, 0.148103976427480074590, 0.0151986665636164571966, 5.47593808499534494600e-4, 1.05075007164441684324e-9),
    )
    far = (
        (6.65790464350110377720, 5.46378491116411436990, 1.78482653991729133580, 0.296560571828504891230, 0.0265321895265761230930, 0.00124266094738807843860, 2.71155556874348757815e-5, 2.01033439929228813265e-7),
        (1.0, 0.599832206555887937690, 0.136929880922735805310, 0.0148753612908506148525, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15),
    )
    q = F.when((p > 0) & (p < 1), p) - 0.5
    r = F.sqrt(-F.ln(F.least(p, 1 - p)))
    tail = F.when(r <= 5, _ratio(r - 1.6, *near)).otherwise(_ratio(r - 5, *far))
    return F.when(F.abs(q) <= 0.425, q * _ratio(0.180625 - q * q, *middle)).when(q < 0, -tail).when(q > 0, tail)
