"""Scalar functions: keys, times, text parsing, ladders, vectors, option and market arithmetic."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import CFI, CFI_FIRST, CREDIT_TIERS, ESG, IDENTIFIERS, MARKETS, MOODY_RATINGS, SP_RATINGS

# --- keys -----------------------------------------------------------------------------------------------------

def base_id(text: str = "bpk"):
    """XXH64 with seed 0 of the UTF-8 text, as a signed long.

    Spark's ``xxhash64`` has seed 42 fixed, so the ids come from an Arrow function.
    """

    @F.pandas_udf("long")
    def hashed(values: pd.Series) -> pd.Series:
        import xxhash

        return values.map(lambda v: None if v is None else np.uint64(xxhash.xxh64_intdigest(v.encode(), 0)).astype(np.int64)).astype("Int64")

    return hashed(F.col(text))


def business_key(kind: Column, identifiers: dict[str, Column]) -> Column:
    """``KIND|IDTYPE|VALUE`` with the first identifier, in the kind's order, that is not empty; null without one or for an unknown kind."""
    given = {name.upper(): value for name, value in identifiers.items()}
    kind, out = F.upper(kind), F.lit(None).cast("string")
    for name, order in IDENTIFIERS.items():
        found = [F.when(given[i] != "", F.concat_ws("|", F.lit(name), F.lit(i), given[i])) for i in order if i in given]
        if found:
            out = F.when(kind == name, F.coalesce(*found)).otherwise(out)
    return out


def valid_business_key(key: Column, entity: str = "security") -> Column:
    """Whether a key is not empty, has no blanks around it, and the parts of its entity: three of a security, two of a model."""
    ok = (key != "") & (key == F.trim(key))
    parts = F.split(key, r"\|", -1)
    if entity == "security":
        ok = ok & (F.size(parts) == 3) & F.try_element_at(parts, F.lit(1)).isin(*IDENTIFIERS) & (F.try_element_at(parts, F.lit(3)) != "")
    elif entity == "model":
        ok = ok & (F.size(parts) == 2)
    return F.coalesce(ok, F.lit(False))


def version_stamp(base: Column, number: Column) -> Column:
    """A time that rises by at least a microsecond from row to row."""
    return F.timestamp_micros(F.unix_micros(base) + number)


# --- times ----------------------------------------------------------------------------------------------------


def iso_utc(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def to_ms(text: Column) -> Column:
    """Milliseconds of a text that is an epoch in seconds or milliseconds, a date, or an ISO time with or without a zone."""
    number = F.try_to_number(F.when(text.rlike(r"^\d{9,14}$"), text), F.lit("99999999999999")).cast("long")
    parsed = F.try_to_timestamp(F.regexp_replace(text, "Z$", "+00:00"))
    return F.coalesce(F.when(number < 100_000_000_000, number * 1000).otherwise(number), F.unix_millis(parsed))


def julian_ms(text: Column) -> Column:
    return F.unix_millis(F.try_to_timestamp(text))


def days_to(text: Column, now: Column, default: float = 365.0) -> Column:
    """Days until a date in one of four formats; 0.01 at least, a default if it can't be read."""
    formats = ("yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")
    at = F.coalesce(*(F.try_to_timestamp(text, F.lit(f)) for f in formats))
    left = (F.unix_millis(at) - F.unix_millis(now)) / 86_400_000.0
    return F.when(left.isNull(), F.lit(default)).otherwise(F.greatest(left, F.lit(0.01)))


def temporal_features(ts: Column) -> list[Column]:
    hour, day = F.hour(ts), F.weekday(ts)
    return [hour.alias("hour"), day.alias("weekday"), (day >= 5).alias("is_weekend"), hour.between(0, 7).alias("asia"), hour.between(7, 15).alias("europe"), hour.between(13, 21).alias("america")]


# --- numbers --------------------------------------------------------------------------------------------------


def log_return(now: Column, before: Column) -> Column:
    """Minus infinity for a fall to 0; null from 0 or for a negative ratio."""
    ratio = now / F.nullif(before, F.lit(0.0))
    return F.when(ratio == 0, F.lit(float("-inf"))).otherwise(F.ln(ratio))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def safe_divide(a: Column, b: Column, eps: float = 1e-10) -> Column:
    return a / F.when(F.abs(b) < eps, F.lit(eps)).otherwise(b)


def finite(x: Column, default: float = 0.0) -> Column:
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default)).otherwise(x)


def fahrenheit(celsius: Column) -> Column:
    return celsius * 9 / 5 + 32


def spread_bps(bid: Column, ask: Column) -> Column:
    return (ask - bid) / F.nullif((ask + bid) / 2, F.lit(0.0)) * 10_000


# --- text -----------------------------------------------------------------------------------------------------


def classify(text: Column, rules: dict[str, list[str]], default: str = "other") -> Column:
    """The first category with a keyword in the text."""
    low = F.lower(text)
    out = F.lit(default)
    for name, words in reversed(rules.items()):
        out = F.when(low.rlike("|".join(words)), name).otherwise(out)
    return out


def entities(text: Column, names: dict[str, tuple[list[str], list[str]]]) -> Column:
    """Entities that a text names by whole words, unless one of their excluding words is there too."""
    found = [F.when(text.rlike(rf"(?i)\b({'|'.join(words)})\b") & ~(text.rlike(rf"(?i)\b({'|'.join(no)})\b") if no else F.lit(False)), F.lit(n)) for n, (words, no) in names.items()]
    return F.array_compact(F.array(*found))


def periods(text: Column) -> Column:
    """Quarters and years that a text names, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?i)\b(q[1-4] \d{4}|20\d{2})\b"), F.lit(1))


def thresholds(text: Column) -> Column:
    """Amounts with an optional k, m, b or % as numbers."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(r"\$?(\d[\d,]*\.?\d*[kKmMbB%]?)"), F.lit(1)),
        lambda x: F.regexp_replace(x, "[,kKmMbB%]", "").try_cast("double") * F.when(x.rlike("[kK]$"), 1e3).when(x.rlike("[mM]$"), 1e6).when(x.rlike("[bB]$"), 1e9).when(x.rlike("%$"), 0.01).otherwise(1.0),
    )


def slug_parts(slug: Column) -> list[Column]:
    """City and day of a temperature market's slug."""
    city = F.regexp_replace(F.regexp_extract(slug, r"temperature-in-([a-z-]+?)-on-", 1), "-", " ")
    day = F.try_to_timestamp(F.initcap(F.regexp_replace(F.regexp_extract(slug, r"-on-([a-z]+-\d{1,2}-\d{4})", 1), "-", " ")), F.lit("MMMM d yyyy")).cast("date")
    return [F.nullif(city, F.lit("")).alias("city"), day.alias("day")]


def bucket_bounds(text: Column) -> list[Column]:
    """Lower and upper bound of a temperature bucket: ``41-42``, ``50 or below``, ``61 or higher``."""
    pair = lambda i: F.regexp_extract(text, r"(-?\d+)\s*[-–]\s*(-?\d+)", i).try_cast("double")
    one = F.regexp_extract(text, r"(-?\d+)", 1).try_cast("double")
    low = F.when(text.rlike("(?i)or (below|lower)"), F.lit(None)).when(text.rlike("(?i)or (above|higher)"), one).otherwise(pair(1))
    high = F.when(text.rlike("(?i)or (below|lower)"), one).when(text.rlike("(?i)or (above|higher)"), F.lit(None)).otherwise(pair(2))
    return [low.alias("low"), high.alias("high")]


def normalise_ticker(raw: Column, overrides: dict[str, str]) -> Column:
    """Trimmed; an override wins, else dots become dashes."""
    text = F.trim(raw)
    out = F.replace(text, F.lit("."), F.lit("-"))
    for a, b in overrides.items():
        out = F.when(text == a, F.lit(b)).otherwise(out)
    return out


def sentiment(text: Column, good: list[str], bad: list[str]) -> Column:
    """``(good - bad) / words`` over the words of a text."""
    words = F.split(F.lower(F.trim(text)), r"\s+")
    count = lambda listed: F.size(F.filter(words, lambda w: w.isin(listed)))
    return (count(good) - count(bad)) / F.greatest(F.size(words), F.lit(1))


def first_number(text: Column) -> Column:
    """First number of a list in JSON (numbers or strings)."""
    return F.element_at(F.from_json(text, "array<string>"), 1).try_cast("double")


# --- ladders --------------------------------------------------------------------------------------------------


def lookup(key: Column, table: dict) -> Column:
    """A small map as an expression."""
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in table.items() for x in kv)), key)


def credit_rank(rating: Column, agency: str) -> Column:
    """Rank of a rating from 1 (best) on the ladder of ``sp`` (letters of any case) or ``moody`` (as they are written)."""
    if agency == "sp":
        return lookup(F.upper(F.trim(rating)), {r: i for i, r in enumerate(SP_RATINGS, 1)})
    return lookup(F.trim(rating), {r: i for i, r in enumerate(MOODY_RATINGS, 1)})


def credit_tier(rank: Column) -> Column:
    out = F.lit(None).cast("string")
    for tier, last in reversed(CREDIT_TIERS.items()):
        out = F.when(rank <= last, tier).otherwise(out)
    return out


def moody_of_sp(rating: Column) -> Column:
    """The other agency's name of the same rank; it has none for the last one."""
    return F.try_element_at(F.array(*map(F.lit, MOODY_RATINGS)), credit_rank(rating, "sp"))


def compare_ratings(sp: Column, moody: Column) -> list[Column]:
    """Ranks apart, whether both agree on investment grade, and whether the issuer is split rated; null where one is unknown."""
    a, b = credit_rank(sp, "sp"), credit_rank(moody, "moody")
    grade = CREDIT_TIERS["INVESTMENT_GRADE"]
    agree = (a <= grade) == (b <= grade)
    return [F.abs(a - b).alias("notch_difference"), agree.alias("ig_agreement"), (~agree).alias("split_rated")]


def market_tier(country: Column) -> list[Column]:
    """Tier and region of a country by its code."""
    code = F.upper(F.trim(country))
    tier = {c: t for t, regions in MARKETS.items() for codes in regions.values() for c in codes}
    region = {c: r for regions in MARKETS.values() for r, codes in regions.items() for c in codes}
    return [lookup(code, tier).alias("market_tier"), lookup(code, region).alias("region")]


def esg_tier(rating: Column) -> list[Column]:
    """Tier and number of an ESG rating."""
    code = F.upper(F.trim(rating))
    return [lookup(code, {k: v[0] for k, v in ESG.items()}).alias("esg_tier"), lookup(code, {k: v[1] for k, v in ESG.items()}).alias("esg_number")]


def cfi_decode(code: Column) -> list[Column]:
    """Class, type and settlement of a CFI code by its first two letters, else by the first; null below two letters."""
    two, one = F.upper(F.substring(code, 1, 2)), F.upper(F.substring(code, 1, 1))
    of = lambda i: F.when(F.length(code) >= 2, F.coalesce(lookup(two, {k: v[i] for k, v in CFI.items()}), lookup(one, {k: v[i] for k, v in CFI_FIRST.items()})))
    return [of(0).alias("asset_class"), of(1).alias("asset_type"), of(2).alias("settlement")]


# --- vectors --------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


# --- options and markets --------------------------------------------------------------------------------------

_PHI = np.vectorize(lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2))), otypes=[float])


def _d1_d2(s, k, t, r, q, v):
    d1 = (np.log(s / k) + (r - q + 0.5 * v * v) * t) / (v * np.sqrt(t))
    return d1, d1 - v * np.sqrt(t)


def bs_price_np(s, k, t, r, v, q=0.0, call=True):
    """European price; intrinsic value without time or volatility."""
    s, k, t, v = (np.asarray(x, float) for x in (s, k, t, v))
    with np.errstate(divide="ignore", invalid="ignore"):
        d1, d2 = _d1_d2(s, k, t, r, q, v)
        sign = np.where(call, 1.0, -1.0)
        price = sign * (s * np.exp(-q * t) * _PHI(sign * d1) - k * np.exp(-r * t) * _PHI(sign * d2))
    return np.where((t <= 0) | (v <= 0), np.maximum(sign * (s - k), 0), price)


def bs_greeks_np(s, k, t, r, v, q=0.0, call=True) -> dict[str, np.ndarray]:
    """Delta, gamma, theta a day, vega and rho a point, vanna, volga."""
    d1, d2 = _d1_d2(s, k, t, r, q, v)
    pdf, sign = np.exp(-0.5 * d1 * d1) / math.sqrt(2 * math.pi), np.where(call, 1.0, -1.0)
    carry, disc, root = np.exp(-q * t), np.exp(-r * t), np.sqrt(t)
    vega = s * carry * pdf * root
    return {
        "delta": sign * carry * _PHI(sign * d1), "gamma": carry * pdf / (s * v * root),
        "theta": (-s * carry * pdf * v / (2 * root) - sign * r * k * disc * _PHI(sign * d2) + sign * q * s * carry * _PHI(sign * d1)) / 365,
        "vega": vega / 100, "rho": sign * k * t * disc * _PHI(sign * d2) / 100, "vanna": -carry * pdf * d2 / v, "volga": vega * d1 * d2 / v,
    }


def implied_vol_np(price, s, k, t, r, q=0.0, call=True, steps: int = 80) -> np.ndarray:
    """Volatility by bisection on all rows at once; NaN where no volatility up to 500 % gives the price."""
    low, high = np.full(len(price), 1e-6), np.full(len(price), 5.0)
    ok = (bs_price_np(s, k, t, r, low, q, call) <= price) & (bs_price_np(s, k, t, r, high, q, call) >= price)
    for _ in range(steps):
        mid = (low + high) / 2
        above = bs_price_np(s, k, t, r, mid, q, call) > price
        high, low = np.where(above, mid, high), np.where(above, low, mid)
    return np.where(ok, (low + high) / 2, np.nan)


def bs_price(rate: float, dividend: float = 0.0):
    """An Arrow function of spot, strike, years, volatility and whether it is a call."""

    @F.pandas_udf("double")
    def price(s: pd.Series, k: pd.Series, t: pd.Series, v: pd.Series, call: pd.Series) -> pd.Series:
        return pd.Series(bs_price_np(s, k, t, rate, v, dividend, call.to_numpy()))

    return price


def implied_vol(rate: float, dividend: float = 0.0):
    """An Arrow function of price, spot, strike, years and whether it is a call."""

    @F.pandas_udf("double")
    def vol(p: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, call: pd.Series) -> pd.Series:
        return pd.Series(implied_vol_np(p.to_numpy(), s.to_numpy(), k.to_numpy(), t.to_numpy(), rate, dividend, call.to_numpy()))

    return vol


#: Fixed values of binary markets: winner's fee, riskless rate, least annual return, share of Kelly.
FEE, RISKLESS, LEAST_RETURN, KELLY_SHARE = 0.02, 0.045, 0.10, 0.25


def expected_value(price: Column, prob: Column, fee: float = FEE) -> Column:
    """Per unit invested; 0 outside (0, 1)."""
    return F.when((price > 0) & (price < 1), (prob * (1 - fee) - price) / price).otherwise(0.0)


def annualised(ev: Column, days: Column) -> Column:
    """Compounded to a year, 100 at most."""
    return F.when(days <= 0, 0.0).when(ev <= -1, -1.0).otherwise(F.least(F.pow(1 + ev, 365 / days) - 1, F.lit(100.0)))


def kelly(prob: Column, price: Column, fee: float = FEE, share: float = KELLY_SHARE) -> Column:
    odds = F.lit(1 - fee) / price - 1
    return F.when((price > 0) & (price < 1) & (prob > 0) & (odds > 0), F.greatest((odds * prob - (1 - prob)) / odds * share, F.lit(0.0))).otherwise(0.0)


def capital_efficiency(annual: Column, days: Column) -> Column:
    return F.when((days > 0) & (annual > 0), annual * F.least(365 / F.greatest(days, F.lit(1.0)), F.lit(52.0))).otherwise(0.0)


def longshot_rate(price: Column) -> Column:
    """Win rate of a price, corrected for the longshot bias by steps (fixed values)."""
    out = price
    steps = F.when(price < 0.05, price * 0.30).when(price < 0.10, price * 0.50).when(price < 0.20, price * 0.70).when(price < 0.30, price * 0.85)
    return steps.when(price > 0.95, F.least(price * 1.03, F.lit(0.99))).when(price > 0.90, F.least(price * 1.02, F.lit(0.99))).when(price > 0.80, F.least(price * 1.01, F.lit(0.99))).otherwise(out)


# --- pools ----------------------------------------------------------------------------------------------------

Q96 = 1 << 96


def pool_price(sqrt_price_x96: int, decimals0: int, decimals1: int) -> float:
    return (sqrt_price_x96 / Q96) ** 2 * 10 ** (decimals0 - decimals1)


def swap_output(sqrt_price_x96: int, liquidity: int, amount_in: int, fee: int, zero_for_one: bool) -> tuple[int, int]:
    """Output of a swap inside one price range, and the price after it, in whole numbers; ``fee`` in millionths.

    The new price rounds against the trader.
    """
    paid = amount_in * (1_000_000 - fee) // 1_000_000
    if zero_for_one:
        num = liquidity << 96
        after = -(-num * sqrt_price_x96 // (num + paid * sqrt_price_x96))
        return liquidity * (sqrt_price_x96 - after) // Q96, after
    after = sqrt_price_x96 + (paid << 96) // liquidity
    return (liquidity << 96) * (after - sqrt_price_x96) // after // sqrt_price_x96, after


def resolve(ref: str, outputs: dict):
    """A dotted path into nested results: ``step.field.inner``."""
    out = outputs
    for name in ref.split("."):
        out = out[name] if isinstance(out, dict) else getattr(out, name)
    return out


def condition(text: str, outputs: dict) -> bool:
    """``reference op literal`` with ``== != >= <= > <``."""
    import operator as op

    for sign, f in (("==", op.eq), ("!=", op.ne), (">=", op.ge), ("<=", op.le), (">", op.gt), ("<", op.lt)):
        if sign in text:
            left, right = (x.strip() for x in text.split(sign, 1))
            value = resolve(left, outputs)
            literal = {"true": True, "false": False, "none": None}.get(right.lower(), right.strip("'\""))
            return f(value, type(value)(literal) if isinstance(value, (int, float)) and not isinstance(value, bool) else literal)
    return bool(resolve(text.strip(), outputs))
