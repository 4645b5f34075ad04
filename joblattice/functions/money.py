"""Money and number functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let

# Exchange rates to AUD, currencies of countries, countries of single-country boards, markers
# of currencies in order of precedence.
FX_TO_AUD = {"AUD": 1.0, "USD": 1.420319, "GBP": 1.91459, "EUR": 1.638525, "CAD": 1.013292, "NZD": 0.837048, "SGD": 1.108501, "MYR": 0.348539, "PHP": 0.023196, "CNY": 0.21033, "HKD": 0.181197, "INR": 0.014882, "JPY": 0.008981, "KRW": 0.000986, "AED": 0.386764, "SAR": 0.378771, "QAR": 0.390218, "THB": 0.04255, "IDR": 0.000079, "CHF": 1.758582, "ZAR": 0.086135}
CURRENCY_OF = {"au": "AUD", "nz": "NZD", "us": "USD", "gb": "GBP", "uk": "GBP", "ca": "CAD", "sg": "SGD", "my": "MYR", "ph": "PHP", "cn": "CNY", "hk": "HKD", "in": "INR", "jp": "JPY", "kr": "KRW", "ae": "AED", "sa": "SAR", "qa": "QAR", "th": "THB", "id": "IDR", "ch": "CHF", "za": "ZAR", "de": "EUR", "fr": "EUR", "es": "EUR", "it": "EUR", "nl": "EUR", "ie": "EUR", "be": "EUR", "at": "EUR", "pt": "EUR", "fi": "EUR"}
COUNTRY_OF_SOURCE = {"wa-gov": "au", "sa-gov": "au", "vic-gov": "au", "qld-gov": "au", "nsw-gov": "au", "nt-gov": "au", "tas-gov": "au", "aps-gov": "au", "nz-gov": "nz", "mycareersfuture": "sg", "jobstreet": "my", "jobstreet-ph": "ph", "zhaopin": "cn", "naukri": "in", "gulftalent": "ae", "jobsdb-hk": "hk", "simplyhired": "au"}
MARKERS = [(r"US\$|\bUSD\b", "USD"), (r"NZ\$|\bNZD\b", "NZD"), (r"HK\$|\bHKD\b", "HKD"), (r"S\$|\bSGD\b", "SGD"), (r"A\$|\bAUD\b", "AUD"), (r"C\$|\bCAD\b", "CAD"), (r"\bRM\b|\bMYR\b", "MYR"), (r"₱|\bPHP\b", "PHP"), (r"\bCNY\b|元|万|¥", "CNY"), (r"₹|\bINR\b", "INR"), (r"£|\bGBP\b", "GBP"), (r"€|\bEUR\b", "EUR"), (r"\bAED\b", "AED"), (r"\bSAR\b", "SAR"), (r"\bQAR\b", "QAR"), (r"\bTHB\b", "THB"), (r"\bIDR\b", "IDR"), (r"\bCHF\b", "CHF"), (r"\bZAR\b", "ZAR")]
HOURS_A_YEAR, DAYS_A_YEAR, WEEKS_A_YEAR = 1748, 230, 46
LEAST_YEAR, MOST_YEAR = 5_000, 600_000
NUMBER = r"\d[\d,]*(?:\.\d+)?"


def half_up(x: Column, digits: int = 0) -> Column:
    """Rounded, halves toward plus infinity."""
    scale = 10**digits
    return F.floor(x * scale + 0.5) / scale if digits else F.floor(x + 0.5)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def _numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda n: F.replace(n, F.lit(","), F.lit("")).cast("double"))


def annual_aud(salary: Column, country: Column, source: Column) -> Column:
    """A salary text in AUD a year: midpoint of its least and largest plausible figure; null if unreadable."""
    return let(F.trim(salary), lambda text: _annual_aud(text, country, source))


def _annual_aud(text: Column, country: Column, source: Column) -> Column:
    low = F.lower(text)
    marker = F.coalesce(*[F.when(text.rlike(f"(?i){p}"), F.lit(code)) for p, code in MARKERS])
    currency = F.coalesce(marker, _lookup(CURRENCY_OF, F.coalesce(country, _lookup(COUNTRY_OF_SOURCE, source))))
    wan = text.contains("万")
    scale = F.when(wan, 10_000.0).when(text.rlike(r"(?i)\d\s*k\b"), 1_000.0).otherwise(1.0)
    yearly = low.rlike(r"\bper year\b|\byearly\b|\bper annum\b|\bp\.?a\.?\b|/yr\b|年薪")
    months = F.coalesce(F.nullif(F.regexp_extract(text, r"(\d{2})\s*薪", 1), F.lit("")).cast("double"), F.lit(12.0))
    times = (
        F.when(low.rlike(r"\ban hour\b|\bper hour\b|\bhourly\b|/hr\b|/hour\b"), float(HOURS_A_YEAR))
        .when(low.rlike(r"\bper day\b|\bdaily\b|/day\b|元\s*/\s*天|/天"), float(DAYS_A_YEAR))
        .when(low.rlike(r"\bper week\b|\bweekly\b|/wk\b"), float(WEEKS_A_YEAR))
        .when(low.rlike(r"\bper month\b|\bmonthly\b|/mo\b|/month\b|/月") | (~yearly & (wan | text.contains("元"))), months)
        .otherwise(1.0)
    )
    # Inside a function over figures, rules of the text would run once for every figure.
    read = F.struct(_numbers(text).alias("n"), scale.alias("scale"), times.alias("times"), _lookup(FX_TO_AUD, currency).alias("rate"))
    each = let(read, lambda r: F.transform(r["n"], lambda n: n * r["scale"] * r["times"] * r["rate"]))  # all null without a rate
    fair = F.filter(each, lambda v: (v >= LEAST_YEAR) & (v <= MOST_YEAR))
    return let(fair, lambda vs: F.when(F.size(vs) > 0, half_up((F.array_min(vs) + F.array_max(vs)) / 2).cast("long")))


def parsed_pay(raw: Column, fallback: Column) -> Column:
    """The analyst's reading of a pay text as struct(annual, currency): figures in 万 a month, S$ by the
    month if tagged or below 30,000, bands in k, plain figures of 20,000 or more; else null."""
    return let(F.trim(raw), lambda text: _parsed_pay(text, fallback))


def _parsed_pay(text: Column, fallback: Column) -> Column:
    number = lambda c: F.replace(F.nullif(c, F.lit("")), F.lit(","), F.lit("")).cast("double")
    pay = lambda annual, currency: F.struct(annual.cast("double").alias("annual"), currency.alias("currency"))
    wan = rf"({NUMBER})\s*(?:[-–~]\s*({NUMBER}))?\s*万"
    sgd = rf"S\$\s*({NUMBER})(?:\s*[-–]\s*S?\$?\s*({NUMBER}))?"
    both = lambda rule: F.struct(*[number(F.regexp_extract(text, rule, i)).alias(f"_{i}") for i in (1, 2)])
    bands = F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)({NUMBER})\s*k\b"), F.lit(1)), lambda n: number(n) * 1000)
    plain = F.filter(_numbers(text), lambda n: n > 0)
    centre = lambda p: (p["_1"] + F.coalesce(p["_2"], p["_1"])) / 2
    middle = lambda xs: let(xs, lambda v: (F.array_min(v) + F.array_max(v)) / 2)
    monthly = lambda mid: text.rlike(r"(?i)/\s*mo|per month|monthly") | (mid < 30_000)
    # Each rule is read where the one before finds nothing, and once.
    in_wan = let(both(wan), lambda p: F.when(p["_1"].isNotNull(), pay(centre(p) * 120_000, F.lit("CNY"))))
    in_sgd = let(let(both(sgd), centre), lambda mid: F.when(mid.isNotNull(), pay(F.when(monthly(mid), mid * 12).otherwise(mid), F.lit("SGD"))))
    in_bands = let(middle(bands), lambda v: F.when(v.isNotNull(), pay(v, fallback)))
    in_figures = let(middle(plain), lambda v: F.when(v >= 20_000, pay(v, fallback)))
    return F.coalesce(in_wan, in_sgd, in_bands, in_figures)


def board_salary(low: Column, high: Column, period: Column) -> Column:
    """A board's own range in a year: months times 12, hours times 2,080."""
    times = F.when(F.lower(period) == "monthly", 12).when(F.lower(period) == "hourly", 2080).otherwise(1)
    return (low + F.coalesce(high, low)) / 2 * times


def openings(employed: Column, rate: Column) -> Column:
    """Openings from employment and an openings rate; null unless 0 <= rate < 1."""
    return F.when((rate >= 0) & (rate < 1), employed * rate / (1 - rate))


def per_thousand(vacancies: Column, employed: Column, least: float = 1000) -> Column:
    """Vacancies per 1,000 employed, to one decimal; null where the denominator is missing or small."""
    return F.when(employed >= least, half_up(1000 * vacancies / employed, 1))


def heat_position(v: Column, least: Column, most: Column) -> Column:
    """Square-root scale from least to most; 0.5 where they are equal."""
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0)))
    return F.when(most > least, (root(v) - root(least)) / (root(most) - root(least))).otherwise(0.5)


def gap(a: Column, b: Column, flat: float = 0.5) -> Column:
    """How far a lies over b in percent, to one decimal; 0 within the flat band, null without a base."""
    pct = half_up(100 * (a - b) / b, 1)
    return F.when(b > 0, F.when(F.abs(pct) < flat, 0.0).otherwise(pct))
