"""Scalar functions as column expressions; all stay inside generated code."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from siltstone import vocab

FOLD_FROM = "áàâäãåąăčćçďéèêëěęíìîïłĺľñňńóòôöõőŕřšśşșťţțúùûüűůýÿžźż"
FOLD_TO = "".join("l" if c == "ł" else unicodedata.normalize("NFKD", c)[0] for c in FOLD_FROM)


def sdmx_number(raw: Column) -> Column:
    """The first number of a cell, thousands commas left out; flags and ':' give null."""
    return F.nullif(F.replace(F.regexp_extract(raw, r"([-\d.,]+)", 1), F.lit(","), F.lit("")), F.lit("")).try_cast("double")


def german_number(raw: Column) -> Column:
    """A number with decimal comma and grouping points or spaces; '-', '.' and '..' give null."""
    text = F.regexp_replace(F.trim(raw), "[\\s ]", "")
    grouped = text.rlike(r"^-?\d{1,3}(\.\d{3})+(,\d+)?$")
    plain = F.when(grouped, F.replace(text, F.lit("."), F.lit(""))).otherwise(text)
    return F.replace(plain, F.lit(","), F.lit(".")).try_cast("double")


def year_of_text(raw: Column) -> Column:
    """The first year from 1900 to 2099 in a text."""
    return F.nullif(F.regexp_extract(raw, r"((?:19|20)\d{2})", 1), F.lit("")).cast("long")


def news_time(raw: Column) -> Column:
    """A timestamp from compact, ISO or RFC 822 text; anything else gives null."""
    text = F.trim(raw)
    rfc = F.regexp_replace(text, "^[A-Za-z]{3}, *", "")
    parse = lambda c, f: F.try_to_timestamp(c, F.lit(f))
    compact = F.when(text.rlike(r"^\d{8}T\d{6}Z$"), parse(text, "yyyyMMdd'T'HHmmss'Z'")).when(text.rlike(r"^\d{14}$"), parse(text, "yyyyMMddHHmmss")).when(text.rlike(r"^\d{8}$"), parse(text, "yyyyMMdd"))
    return F.coalesce(compact, F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}([T ].*)?$"), text.try_cast("timestamp")), parse(rfc, "d MMM yyyy HH:mm:ss Z"), parse(rfc, "d MMM yyyy HH:mm:ss z"))


def geo_level(geo: Column) -> Column:
    g = F.upper(F.trim(geo))
    return F.when(g.rlike("^(EU|EA)"), "aggregate").when(g.rlike("^[A-Z]{2}$"), "country").when(g.rlike("^[A-Z]{2}[A-Z0-9]{1,3}$"), "region").otherwise("aggregate")


def url_key(url: Column) -> Column:
    """A URL as matching compares it."""
    return F.lower(F.rtrim(F.trim(url), F.lit("/")))


def fold(text: Column) -> Column:
    """Lower case without accents, for the alphabets of the vocabularies."""
    return F.translate(F.lower(text), FOLD_FROM, FOLD_TO)


def sentiment_score(score: Column, label: Column) -> Column:
    """The signed score, or the label's where there is none."""
    by_label = F.lit(None).cast("double")
    for name, value in vocab.SENTIMENT_SCORE.items():
        by_label = F.when(label == name, value).otherwise(by_label)
    return F.coalesce(score, by_label)


def tone_sentiment(tone: Column) -> Column:
    return F.when(tone > 1, "positive").when(tone < -1, "negative").when(tone.isNotNull(), "neutral")


def theme_event(themes: Column) -> Column:
    """The event of the first rule with a theme inside the text."""
    out = F.lit("other")
    for event, keys in reversed(vocab.THEME_RULES):
        hit = F.lit(False)
        for key in keys:
            hit = hit | F.upper(themes).contains(key)
        out = F.when(hit, event).otherwise(out)
    return out


def operators_in(text: Column) -> Column:
    """Known operators whose folded alias stands in the text, in the vocabulary's order."""
    folded = fold(text)
    found = []
    for name, aliases in vocab.OPERATOR_ALIASES.items():
        hit = F.lit(False)
        for alias in aliases:
            hit = hit | folded.contains(alias)
        found.append(F.when(hit, name))
    return F.array_compact(F.array(*found))


def cosine(x: Column, y: Column) -> Column:
    """Cosine of two arrays; null where one has no length."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y)))


def fisher_z(r: Column, n: Column) -> Column:
    """atanh(r) * sqrt(n - 3): null below four pairs or for a perfect correlation."""
    return F.when((n >= 4) & (F.abs(r) < 1), F.atanh(r) * F.sqrt(n - 3))


def bool_or_null(raw: Column) -> Column:
    text = F.lower(F.trim(raw))
    return F.when(text.isin("true", "1", "yes", "y"), True).when(text.isin("false", "0", "no", "n"), False)


def clamped(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def two_sided_p(z: Column) -> Column:
    """The probability of a larger |z| under the normal law, erfc(|z| / sqrt 2), by Chebyshev fitting; its relative error is below 2e-7."""
    x = F.abs(z) / 2**0.5
    t = 1 / (1 + x / 2)
    # Coefficients of a published fit of erfc, the highest power first.
    fit = [0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368, -1.26551223]
    sum_ = F.lit(fit[0])
    for c in fit[1:]:
        sum_ = sum_ * t + c
    return t * F.exp(sum_ - x * x)


def fisher_p(r: Column, n: Column) -> Column:
    """The two-sided p of a correlation by Fisher's z: null below four pairs or for a perfect one."""
    return two_sided_p(fisher_z(r, n))


def string_list(raw: Column) -> Column:
    """A delimited text or JSON list as an array of trimmed entries that aren't empty; null gives an empty one."""
    text = F.trim(raw)
    listed = F.coalesce(F.when(text.startswith("["), F.from_json(text, "array<string>")), F.split(text, ";"))
    return F.filter(F.transform(F.coalesce(listed, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")


def month_window(day: Column) -> Column:
    """The first and last day of a date's month, as struct (first, last)."""
    return F.struct(F.trunc(day, "month").cast("date").alias("first"), F.last_day(day).alias("last"))


def digits_date(raw: Column) -> Column:
    """A date from the first eight digits of a text, whatever stands between them; null where they are no date."""
    return F.try_to_timestamp(F.substring(F.regexp_replace(raw, r"\D", ""), 1, 8), F.lit("yyyyMMdd")).cast("date")
