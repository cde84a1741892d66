"""News features by group, in one pass over the articles where the grain allows it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone import schemas, vocab
from siltstone.functions.columns import bool_or_null, clamped, sentiment_score

BINS = {"low": (None, 0.33), "medium": (0.33, 0.67), "high": (0.67, None)}


def relevant(news: DataFrame, monthly: bool = False) -> DataFrame:
    """Rail news of the home countries with a date; confidences outside [0, 1] become null and unknown events other."""
    kept = news.where(F.col("is_rail_related") & F.col("country").isin(vocab.HOME_COUNTRIES) & F.col("year").isNotNull())
    kept = kept.where(F.col("month").isNotNull()) if monthly else kept
    return kept.withColumns({
        "confidence": F.when(F.col("confidence").between(0, 1), F.col("confidence")),
        "event_type": F.when(F.trim("event_type").isin(vocab.EVENT_TYPES), F.trim("event_type")).otherwise("other"),
        "language": language_code(F.col("language")),
    })


def language_code(raw: Column, aliases: bool = True) -> Column:
    """A two-letter language code, trimmed and in lower case; null for what is none."""
    code = F.lower(F.trim(raw))
    for old, new in vocab.LANGUAGE_ALIASES.items() if aliases else ():
        code = F.when(code == old, new).otherwise(code)
    return F.when(code.isin(vocab.LANGUAGE_CODES), code)


def core(kept: DataFrame, keys: list[str]) -> DataFrame:
    score = sentiment_score(F.col("sentiment_score"), F.col("sentiment"))
    return kept.groupBy(*keys).agg(
        F.count("article_id").alias("news_count"),
        F.avg(score).alias("news_sentiment_mean"),
        F.avg(F.when(F.col("sentiment") == "negative", 1.0).otherwise(0.0)).alias("news_share_negative"),
        F.coalesce(F.sum("money"), F.lit(0.0)).alias("news_money_sum"),
    )


def category_counts(kept: DataFrame, keys: list[str], value: Column, names: list[str], prefix: str) -> DataFrame:
    """A count for each name, 0 where there is none; conditional counts need no pivot and no join."""
    return kept.withColumn("_v", value).groupBy(*keys).agg(*(F.count_if(F.col("_v") == n).alias(f"{prefix}{k}") for k, n in enumerate(names)))


def primary(kept: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    """The most frequent value, of equals the first by alphabet."""
    counted = kept.where(F.col(column).isNotNull()).groupBy(*keys, column).count()
    return counted.groupBy(*keys).agg(F.min(F.struct(-F.col("count"), F.col(column).alias("v")))["v"].alias(out))


def entropy(kept: DataFrame, keys: list[str], column: str, out: str) -> DataFrame:
    """Shannon entropy in nats: ln N - sum(n ln n) / N, from counts."""
    counted = kept.where(F.col(column).isNotNull()).groupBy(*keys, column).count()
    n = F.col("count").cast("double")
    return counted.groupBy(*keys).agg((F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n)).alias(out))


def spread(kept: DataFrame, keys: list[str], column: str, prefix: str) -> DataFrame:
    return kept.groupBy(*keys).agg(*(f(column).alias(f"{prefix}_{n}") for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))))


def confidence_bins(kept: DataFrame, keys: list[str]) -> DataFrame:
    c = F.col("confidence")
    inside = lambda lo, hi: (F.lit(True) if lo is None else c > lo) & (F.lit(True) if hi is None else c <= hi)
    return kept.groupBy(*keys).agg(*(F.count_if(c.isNotNull() & inside(lo, hi)).alias(f"news_confidence_bin_{n}") for n, (lo, hi) in BINS.items()))


def token_rollup(kept: DataFrame, keys: list[str], tokens: Column, out: str) -> DataFrame:
    """Distinct tokens: how many, and sorted in one text. Tokens are made distinct before they are gathered."""
    each = kept.select(*keys, F.explode(tokens).alias("t")).select(*keys, F.trim("t").alias("t")).where("t <> ''").distinct()
    return each.groupBy(*keys).agg(F.count("*").alias(f"{out}_count"), F.array_join(F.array_sort(F.collect_list("t")), ",").alias(f"{out}_list"))


def block(kept: DataFrame, keys: list[str]) -> DataFrame:
    """All news features of a group in one row.

    kept: relevant rows with article_id, sentiment, sentiment_score, money, language, confidence, event_type, operators and rail_lines
    (arrays), gkg_tone and the fields of vocab.GKG_FIELDS. Counts are conditional ones of one aggregate; languages and tokens are made
    distinct, with a combine on the map side, before they are gathered. A group's token lists are the only columns that can grow.
    """
    score = sentiment_score(F.col("sentiment_score"), F.trim("sentiment"))
    among = lambda c, name: F.sum(F.size(F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda o: F.trim(o) == name))).cast("long")
    spread_of = lambda c, prefix: [f(c).alias(f"{prefix}_{n}") for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    c = F.col("confidence")
    inside = lambda lo, hi: (F.lit(True) if lo is None else c > lo) & (F.lit(True) if hi is None else c <= hi)
    whole = kept.groupBy(*keys).agg(
        F.count("article_id").alias("news_article_count"), F.avg(score).alias("news_sentiment_mean"),
        F.avg(F.when(F.trim("sentiment") == "negative", 1.0).otherwise(0.0)).alias("news_share_negative"), F.coalesce(F.sum("money"), F.lit(0.0)).alias("news_total_investment_eur"),
        *(F.count_if(F.col("language") == n).alias(f"news_language_{n}") for n in vocab.LANGUAGES), *spread_of("confidence", "news_confidence"),
        *(F.count_if(c.isNotNull() & inside(lo, hi)).alias(f"news_confidence_bin_{n}") for n, (lo, hi) in BINS.items()), *spread_of("gkg_tone", "news_gkg_tone"),
        *(F.count_if(F.col("event_type") == n).alias(f"news_n_{n}") for n in vocab.EVENT_TYPES), *(among("operators", n).alias(f"news_op_{n}") for n in vocab.OPERATORS),
    )
    languages = primary(kept, keys, "language", "news_language_primary").join(entropy(kept, keys, "language", "news_language_entropy"), keys, "left")
    lines = F.transform(F.coalesce("rail_lines", F.array().cast("array<string>")), lambda t: F.trim(t))
    fields = {"rail_lines": lines} | {f: F.transform(F.split(F.coalesce(f"gkg_{f}", F.lit("")), ";"), lambda t: F.trim(t)) for f in vocab.GKG_FIELDS}
    named = lambda n, v: F.transform(v, lambda t: F.struct(F.lit(n).alias("f"), t.alias("t")))
    each = F.concat(*(named(n, v) for n, v in fields.items()))
    tokens = kept.select(*keys, F.explode(each).alias("x")).select(*keys, "x.f", "x.t").where("t <> ''").distinct()
    name = lambda f: ("news_n_rail_lines_unique", "news_rail_lines_list") if f == "rail_lines" else (f"news_n_gkg_{f}_unique", f"news_gkg_{f}_list")
    rolled = tokens.groupBy(*keys).agg(*(col for f in fields for col in (
        F.count_if(F.col("f") == f).alias(name(f)[0]), F.array_join(F.array_sort(F.collect_list(F.when(F.col("f") == f, F.col("t")))), ",").alias(name(f)[1]))))
    out = whole.join(languages, keys, "left").join(rolled, keys, "left")
    return out.fillna(0, [name(f)[0] for f in fields]).fillna("", [name(f)[1] for f in fields])


def is_count(column: str) -> bool:
    """Whether a news column counts or sums, so that its absence is 0."""
    return column in ("news_article_count", "news_total_investment_eur") or column.startswith(("news_n_", "news_op_", "news_confidence_bin_")) or (column.startswith("news_language_") and column[14:] not in ("primary", "entropy"))


def is_text(column: str) -> bool:
    return column.startswith("news_") and (column.endswith("_list") or column == "news_language_primary")


def validated(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Model output as a news feature, within bounds; nothing raises.

    raw has strings or typed columns of schemas.NEWS_FEATURE by name; absent ones count as null. Enumerations are taken exactly: an
    unknown event type is 'other', an unknown country or sentiment null; known operators stay, and where none of some is known they
    are 'other'; a text instead of a list is one entry. Confidences are clamped to [0, 1], scores to [-1, 1], tones to [-100, 100]; language codes that are none are null. The columns `keep` go along.
    """
    kinds = dict(f.split(" ", 1) for f in schemas.NEWS_FEATURE.split(", "))
    has = set(raw.columns)
    text = lambda c: F.col(c).cast("string") if c in has else F.lit(None).cast("string")
    number = lambda c: text(c).try_cast("double")
    finite = lambda c: F.when(~F.isnan(number(c)), number(c))
    listed = lambda c: (F.col(c) if dict(raw.dtypes).get(c, "").startswith("array") else F.when(text(c) != "", F.array(text(c)))) if c in has else F.lit(None).cast("array<string>")
    one_of = lambda c, names: F.when(text(c).isin(names), text(c))
    operators = F.coalesce(listed("operators"), F.array().cast("array<string>"))
    known = F.filter(operators, lambda o: o.isin(vocab.OPERATORS))
    special = {
        "language": language_code(text("language"), False), "language_detected_code": language_code(F.coalesce(text("language_detected_code"), text("language")), False),
        "is_rail_related": F.coalesce(bool_or_null(text("is_rail_related")), F.lit(False)), "is_duplicate": bool_or_null(text("is_duplicate")),
        "country": one_of("country", [*vocab.HOME_COUNTRIES, "other"]), "event_type": F.coalesce(one_of("event_type", vocab.EVENT_TYPES), F.lit("other")),
        "sentiment": one_of("sentiment", list(vocab.SENTIMENT_SCORE)), "sentiment_label": one_of("sentiment_label", list(vocab.SENTIMENT_SCORE)),
        "operators": F.when((F.size(operators) > 0) & (F.size(known) == 0), F.array(F.lit("other"))).otherwise(known), "rail_lines": F.coalesce(listed("rail_lines"), F.array().cast("array<string>")),
        "sentiment_score": clamped(finite("sentiment_score"), -1.0, 1.0), "gkg_tone": clamped(finite("gkg_tone"), -100.0, 100.0), "gkg_tone_source": one_of("gkg_tone_source", ["gdelt_gkg", "xlm_r_model"]),
        "confidence_schema_version": F.coalesce(text("confidence_schema_version"), F.lit("1.0")), "text_embedding": F.col("text_embedding").cast("array<float>") if "text_embedding" in has else F.lit(None).cast("array<float>"),
    }

    def field(c: str, kind: str) -> Column:
        if c in special:
            return special[c]
        if kind == "double":
            return F.when(finite(c).isNotNull(), clamped(finite(c), 0.0, 1.0)) if c.endswith("confidence") else finite(c)
        return text(c)

    return raw.select(*(keep or []), *(field(c, kind).alias(c) for c, kind in kinds.items()))
