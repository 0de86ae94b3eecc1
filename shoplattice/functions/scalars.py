"""Column helpers shared by every operator. All of them stay inside the JVM."""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, functions as F

from shoplattice.constants import EVENT_WEIGHTS, STOPWORDS

MICROS_PER_DAY = 86_400_000_000.0


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---- time ------------------------------------------------------------------
def ntz(value: datetime | Column) -> Column:
    """Zone-less timestamp literal, so comparisons with Parquet columns are pushed down."""
    if isinstance(value, Column):
        return value
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def micros(c: Column | str) -> Column:
    return F.unix_micros(col(c).cast("timestamp"))


def age_days(as_of: datetime | Column, ts: Column | str) -> Column:
    """Fractional days between ``ts`` and ``as_of``."""
    return (micros(ntz(as_of)) - micros(ts)) / F.lit(MICROS_PER_DAY)


def whole_days(as_of: datetime | Column, ts: Column | str) -> Column:
    return F.floor(age_days(as_of, ts))


def day(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd")


def week_start(ts: Column | str) -> Column:
    """Monday of the week, as a date."""
    return F.to_date(F.date_trunc("week", col(ts)))


def cyclic(c: Column | str, period: int) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * col(c) / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


# ---- numbers ---------------------------------------------------------------
def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def ratio(num: Column | str, den: Column | str, places: int | None = None, default: float | None = 0.0) -> Column:
    """Division that yields ``default`` when the denominator is zero or missing."""
    out = F.when(col(den) != 0, col(num).cast("double") / col(den).cast("double"))
    if default is not None:
        out = F.coalesce(out, F.lit(default))
    return F.round(out, places) if places is not None else out


def pct_change(now: Column | str, before: Column | str) -> Column:
    return F.when(col(before) > 0, F.round((col(now) - col(before)) / col(before) * 100, 2))


def finite(c: Column) -> Column:
    """NaN, infinities and nulls become zero."""
    inf = F.lit(float("inf"))
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == inf), F.lit(0.0)).otherwise(c)


def half_life(age: Column, days: float) -> Column:
    return F.pow(F.lit(0.5), F.greatest(age, F.lit(0.0)) / F.lit(days))


def minmax(value: Column, lo: Column, hi: Column, constant: Column | float = 0.0) -> Column:
    """Scale to [0, 1]; ``constant`` is the result when the range is empty."""
    flat = constant if isinstance(constant, Column) else F.lit(constant)
    return F.when(hi - lo < 1e-9, flat).otherwise((value - lo) / (hi - lo))


def effective_price(price: Column | str = "price", discount: Column | str = "discount_pct") -> Column:
    return F.round(col(price) * (1 - col(discount) / 100.0), 2)


# ---- text ------------------------------------------------------------------
def normalise_query(q: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(col(q), F.lit(""))), r"\s+", " "))


def tokens(text: Column | str, drop_stopwords: bool = True) -> Column:
    found = F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    if not drop_stopwords:
        return found
    return F.filter(found, lambda t: ~t.isin(*STOPWORDS))


def word_ngrams(words: Column, n: int) -> Column:
    """n-grams of words, joined by a space. The lists of first, second, ... words are laid side by side: inside a lambda
    ``words`` would be computed anew for every gram."""
    if n == 1:
        return words
    count = F.greatest(F.size(words) - (n - 1), F.lit(0))
    grams = F.slice(words, F.lit(1), count)
    for start in range(2, n + 1):
        grams = F.zip_with(grams, F.slice(words, F.lit(start), count), lambda a, b: F.concat(a, F.lit(" "), b))
    return grams


def char_wb_ngrams(words: Column, lo: int, hi: int) -> Column:
    """Character n-grams inside space-padded words; a word shorter than n gives itself once."""
    def of_word(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        size = F.length(padded)
        per_n = F.transform(
            F.filter(F.sequence(F.lit(lo), F.lit(hi)), lambda n: n <= F.greatest(size, F.lit(lo))),
            lambda n: F.when(size <= n, F.array(padded)).otherwise(
                F.transform(F.sequence(F.lit(1), size - n + 1), lambda i: F.substring(padded, i, n))),
        )
        return F.flatten(per_n)
    return F.flatten(F.transform(words, of_word))


def contains_any(text: Column, words: Sequence[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def title_label(c: Column | str) -> Column:
    return F.initcap(F.replace(col(c), F.lit("_"), F.lit(" ")))


# ---- maps and vectors ------------------------------------------------------
def lookup(mapping: Mapping[str, float], key: Column | str, default: float | None = 0.0) -> Column:
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    found = F.try_element_at(table, col(key))
    return found if default is None else F.coalesce(found, F.lit(default))


def event_weight(c: Column | str = "event_type", default: float | None = 0.0) -> Column:
    return lookup(EVENT_WEIGHTS, c, default)


def dot(a: Column | str, b: Column | str) -> Column:
    prods = F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda acc, v: acc + v)


def l2_norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def top_labels(pairs: Sequence[tuple[Column, str]], top_n: int, floor: float, prefix: str, empty: str) -> Column:
    """Sentence naming the ``top_n`` largest values above ``floor``; earlier entries win ties."""
    structs = F.array(*[
        F.struct((-value).alias("neg"), F.lit(i).alias("pos"), F.lit(label).alias("label"))
        for i, (value, label) in enumerate(pairs)
    ])
    best = F.filter(F.slice(F.array_sort(structs), 1, top_n), lambda s: -s["neg"] > floor)
    text = F.concat(F.lit(prefix), F.array_join(F.transform(best, lambda s: s["label"]), " and "))
    return F.when(F.size(best) == 0, F.lit(empty)).otherwise(text)
