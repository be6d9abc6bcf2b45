"""Secret scans (operator 9): base patterns and a randomness test battery, DataFrame functions only.

Base findings, leftmost and not overlapping within a kind: `assign`, `access` and `hex`; a span runs from the first to
the end of the last matched character, in code points.  The method adds `random` spans: maximal runs of
`[A-Za-z0-9+/_-]` of `LEAST` characters or more that touch no base span and pass the battery:

* the encoding is inferred (hexadecimal, base 32, base 64 in either alphabet) and symbols become its digits;
* a chi-squared test of the alphabet's uniformity, a runs test about the middle digit and a lag-one serial-correlation
  test give p-values, which Fisher's rule combines; within each band of lengths, the Benjamini-Hochberg rule at
  `FALSE_REJECTIONS` decides on them which tokens are not random, so that among those dismissed by the battery at most
  that share is expected to be random;
* short tokens pass the battery for want of power.  So the likelihood ratio of uniform digits against ordinary letters
  bounds the p-value of "an ordinary word", for which longer tokens need less of a deviation; within each band, the
  Benjamini-Hochberg rule at `FALSE_DISCOVERIES` decides which of the remaining tokens are no ordinary words.

Both rules work on one histogram of at most (bands x BINS x BINS) counts over all documents.

Positions come from marking matches with a private-use character and splitting; that character in a text is first
replaced by another of the same length, which no pattern can match.  Null texts are empty and have no span; repeated
rows are scanned each by themselves; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from transitloom.plans.staging import staged

ASSIGN = r"""((?:(?i:password|passwd|secret|token|api_?key)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
LEAST = 20
TOKEN = r"[A-Za-z0-9+/_-]{%d,}" % LEAST
KINDS = ("assign", "access", "hex", "random")
FALSE_REJECTIONS, FALSE_DISCOVERIES = 0.001, 0.01
BANDS = (32, 64)
BINS = 400
#: Parts of a text whose matches are listed at once; even, so that a block begins outside a match.
BLOCK = 256
_MARK, _OTHER = "", ""
#: Letter frequencies of ordinary words in percent, a to z.
LETTERS = (8.2, 1.5, 2.8, 4.3, 12.7, 2.2, 2.0, 6.1, 7.0, 0.15, 0.77, 4.0, 2.4, 6.7, 7.5, 1.9, 0.095, 6.0, 6.3, 9.1, 2.8, 0.98, 2.4, 0.15, 2.0, 0.074)
HEX_DIGITS = "0123456789abcdef"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE64_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"


def spans(text: Column, pattern: str) -> Column:
    """array<struct<s, e, m>>: start, end and text of each match of `pattern`, in code points.

    A fold copies its list at every step, so matches are listed block by block and the blocks' lists joined.
    """
    parts = F.split(F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, f"{_MARK}$0{_MARK}"), _MARK)
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(False).alias("inside"), F.array().cast("array<struct<s:long,e:long,m:string>>").alias("found"))

    def step(acc, part):
        end = acc["at"] + F.length(part)
        one = F.struct(acc["at"].alias("s"), end.alias("e"), part.alias("m"))
        return F.struct(end.alias("at"), (~acc["inside"]).alias("inside"), F.when(acc["inside"], F.concat(acc["found"], F.array(one))).otherwise(acc["found"]).alias("found"))

    def joined(acc, block):
        own = F.aggregate(block, F.struct(acc["at"].alias("at"), F.lit(False).alias("inside"), zero["found"].alias("found")), step)
        return F.transform(F.array(own), lambda x: F.struct(x["at"].alias("at"), F.lit(False).alias("inside"), F.concat(acc["found"], x["found"]).alias("found")))[0]

    def listed(p):
        number = F.sequence(F.lit(0), F.floor((F.size(p) - 1) / BLOCK).cast("int"))
        return F.aggregate(F.transform(number, lambda b: F.slice(p, b * BLOCK + 1, F.lit(BLOCK))), zero, joined)["found"]

    return F.transform(F.array(parts), listed)[0]


def _named(kind: int, found: Column) -> Column:
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), F.lit(kind).alias("k"), x["e"].alias("e")))


def _tail(z: Column) -> Column:
    """Upper tail of the standard normal distribution for z >= 0 (a rational approximation, error below 1e-7)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def _two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-12), 2 * _tail(F.least(F.abs(z), F.lit(7.0)))))


def battery(token: Column) -> Column:
    """struct<uniform double, ratio double>: the combined p-value of uniform digits, and the log-likelihood ratio of
    uniform digits against ordinary letters."""
    lower, upper = token.rlike("^[0-9a-f]+$"), token.rlike("^[0-9A-F]+$")
    base32 = token.rlike("^[A-Z2-7]+$")
    digits = F.when(lower | upper, F.lit(HEX_DIGITS)).when(base32, F.lit(BASE32_DIGITS)).otherwise(F.lit(BASE64_DIGITS))
    plain = F.when(lower | upper, F.lower(token)).when(base32, token).otherwise(F.translate(token, "-_", "+/"))
    chars = F.filter(F.split(plain, ""), lambda c: c != "")
    def fold(codes, k, n):
        mean = F.aggregate(codes, F.lit(0.0), lambda a, x: a + x) / n
        after = F.slice(codes, F.lit(2), F.size(codes) - 1)
        before = F.slice(codes, F.lit(1), F.size(codes) - 1)
        var = F.aggregate(codes, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        lag = F.aggregate(F.zip_with(before, after, lambda x, y: (x - mean) * (y - mean)), F.lit(0.0), lambda a, x: a + x)
        high = F.size(F.filter(codes, lambda x: x >= k / 2)).cast("double")
        runs = 1 + F.aggregate(F.zip_with(before, after, lambda x, y: F.when((x >= k / 2) != (y >= k / 2), 1.0).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
        squares = F.aggregate(F.transform(F.array_distinct(codes), lambda v: F.pow(F.size(F.filter(codes, lambda x: x == v)).cast("double"), 2)), F.lit(0.0), lambda a, x: a + x)
        chi = k / n * squares - n
        z_chi = F.greatest(F.lit(0.0), (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n)))
        low = n - high
        expected = 2 * high * low / n + 1
        spread = (expected - 1) * (expected - 2) / (n - 1)
        z_runs = F.when((high == 0) | (low == 0) | (spread <= 0), F.lit(7.0)).otherwise((runs - expected) / F.sqrt(F.greatest(spread, F.lit(1e-9))))
        z_serial = F.when(var <= 0, F.lit(7.0)).otherwise(lag / F.greatest(var, F.lit(1e-9)) * F.sqrt(n))
        half = -(F.log(_two_sided(z_chi)) + F.log(_two_sided(z_runs)) + F.log(_two_sided(z_serial)))
        return F.exp(-half) * (1 + half + half * half / 2)

    table = F.array(*[F.lit(x / 101) for x in LETTERS])
    # An ordinary token: a letter by frequency (capitals a tenth as likely), any other character one in a hundred.
    ordinary = F.aggregate(
        F.filter(F.split(token, ""), lambda c: c != ""),
        F.lit(0.0),
        lambda a, c: a + F.log(F.when(c.rlike("[a-z]"), F.lit(0.9) * F.element_at(table, F.ascii(c) - 96)).when(c.rlike("[A-Z]"), F.lit(0.1) * F.element_at(table, F.greatest(F.ascii(c) - 64, F.lit(1)))).otherwise(F.lit(0.01))),
    )
    packed = F.struct(F.transform(chars, lambda c: (F.position(c, digits) - 1).cast("double")).alias("codes"), F.length(digits).cast("double").alias("k"), F.length(token).cast("double").alias("n"))
    # transform over a one-element array names an intermediate value once
    return F.transform(F.array(packed), lambda p: F.struct(fold(p["codes"], p["k"], p["n"]).alias("uniform"), (-p["n"] * F.log(p["k"]) - ordinary).alias("ratio")))[0]


def base_findings(docs: DataFrame) -> DataFrame:
    """doc_id, base (spans with their kinds) and tokens (candidates of the method with their tests)."""
    any_of = "|".join([r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}""", r"AKIA[A-Z0-9]{12}", r"[0-9a-f]{32}", TOKEN])
    text = F.coalesce("text", F.lit(""))
    assign = F.filter(spans(text, ASSIGN), lambda x: F.length(F.regexp_extract(x["m"], ASSIGN, 2)) >= 8)
    access = F.filter(spans(text, ACCESS), lambda x: F.length(x["m"]) >= 16)
    base = F.array_sort(F.concat(_named(0, assign), _named(1, access), _named(2, spans(text, HEX))))
    none = F.array().cast("array<struct<s:long,k:int,e:long>>")
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(text.rlike(any_of), text).alias("text"))
    out = out.select("doc_id", "text", F.when(F.col("text").isNotNull(), base).otherwise(none).alias("base"))
    free = F.filter(spans(F.col("text"), TOKEN), lambda t: ~F.exists("base", lambda b: (b["s"] < t["e"]) & (t["s"] < b["e"])))
    tokens = F.transform(free, lambda t: F.struct(t["s"].alias("s"), t["e"].alias("e"), battery(t["m"]).alias("test")))
    return out.select("doc_id", "base", F.when(F.col("text").isNotNull(), tokens).otherwise(F.array().cast("array<struct<s:long,e:long,test:struct<uniform:double,ratio:double>>>")).alias("tokens"))


def _band(length: Column) -> Column:
    return F.when(length < BANDS[0], 0).when(length < BANDS[1], 1).otherwise(2)


def _bin(evidence: Column) -> Column:
    """Quarter units of natural-log evidence, rounded down: a bin's p-value is at most exp(-bin / 4)."""
    return F.least(F.lit(BINS), F.greatest(F.lit(0), F.floor(F.coalesce(evidence, F.lit(0.0)) * 4))).cast("int")


def _uniform_bin(test: Column) -> Column:
    return _bin(-F.log(F.greatest(test["uniform"], F.lit(1e-300))))


def least_bin(counts: dict[int, int], share: float) -> int:
    """The least bin that the Benjamini-Hochberg rule rejects at `share`; BINS + 1 if none."""
    m, passed, least = sum(counts.values()), 0, BINS + 1
    for b in range(BINS, -1, -1):
        passed += counts.get(b, 0)
        if passed and math.exp(-b / 4) <= share * passed / m:
            least = b
    return least


def thresholds(found: DataFrame, false_rejections: float, false_discoveries: float) -> list[tuple[int, int]]:
    """For each band the least bin of the battery that is dismissed, and the least bin of the ratio that passes."""
    tokens = found.select(F.explode("tokens").alias("t"))
    rows = tokens.select(_band(F.col("t.e") - F.col("t.s")).alias("band"), _uniform_bin(F.col("t.test")).alias("u"), _bin(F.col("t.test.ratio")).alias("r")).groupBy("band", "u", "r").count().collect()
    out = []
    for band in range(len(BANDS) + 1):
        own = [r for r in rows if r["band"] == band]
        by_battery, by_ratio = Counter(), Counter()
        for r in own:
            by_battery[r["u"]] += r["count"]
        dismissed = least_bin(by_battery, false_rejections)
        for r in own:
            if r["u"] < dismissed:
                by_ratio[r["r"]] += r["count"]
        out.append((dismissed, least_bin(by_ratio, false_discoveries)))
    return out


def scan(docs: DataFrame, false_rejections: float = FALSE_REJECTIONS, false_discoveries: float = FALSE_DISCOVERIES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of each row of `docs`."""
    found = staged(base_findings(docs), "findings")
    limits = thresholds(found, false_rejections, false_discoveries)
    dismissed, least = (F.array(*[F.lit(x[k]) for x in limits]) for k in (0, 1))
    band = lambda t: _band(t["e"] - t["s"]) + 1
    passed = F.filter("tokens", lambda t: (_uniform_bin(t["test"]) < F.element_at(dismissed, band(t))) & (_bin(t["test"]["ratio"]) >= F.element_at(least, band(t))))
    every = F.array_sort(F.concat("base", _named(3, passed)))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda x: F.array_join(F.transform(x, lambda y: F.concat_ws(":", F.element_at(kinds, y["k"] + 1), y["s"].cast("string"), y["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"))
