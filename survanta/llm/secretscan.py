"""Secret scans by a battery of randomness tests, in DataFrame functions alone.

Three kinds of span are certain by their form: an assignment to a password-like name, an access key id, a run of hex
digits. Other secrets show only by looking random. Candidates are all runs of 12 characters or more of the base64 alphabets,
with or without digits. For each, the encoding is inferred (hex, base32, base36, base64) and four statistics are taken
against it: chi-squared of the characters over the alphabet and of the classes (upper case, lower case, others), the
changes of class between neighbours, and the serial correlation of neighbouring code points. Their squared normal scores
add up to one figure that is small for random text (its distribution is that of chi-squared with four degrees, within a
factor of two at 0.01) and large for words, paths or counters.

The false-discovery control is length-aware: each band of lengths of each encoding has its own bound, by one rule at every
size of the corpus. First, the p-values of the figures under randomness are put to Benjamini-Hochberg at ``RATE``: what is
rejected is not random, and a random run is lost with odds of about ``RATE`` at most. Second, words must not pass: of runs
with the shape of words (``UNLIKE``) those below the bound are false discoveries, and their share among such runs estimates
those among the others; the largest bound that keeps the estimate under ``RATE`` of all below it holds. Of the word-shaped
runs as many as random runs give by chance (three deviations above the mean) are not counted. Bands hold counts in fixed
bins, so what is gathered is bounded, and texts are scanned once.

Places count code points, ends are exclusive. Java's leftmost matching finds the matches and ``split`` the gaps; the
lengths of both give the places.

Defined cases: null texts count as empty and have no span; repeated rows each give their result; an empty table gives
none; with no word-shaped runs in a band the p-values alone set its bound; only named columns are read.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, functions as F

from .shared import stored

#: Fixed patterns of the three certain kinds and the least length of what is captured.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex")
RANDOM = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{12,}+(?:={1,2}(?![A-Za-z0-9+/_=-]))?"
RATE = 0.01
#: What no run with the shape of words holds: digits, and upper and lower case mixed in short pieces.
UNLIKE = ("[0-9+]|(?<=[A-Z])[a-z]{1,2}(?![a-z])|(?<![A-Za-z])[a-z]{1,2}(?=[A-Z])|(?<![A-Z])[A-Z]{2}(?![A-Z])"
          "|(?<![A-Z])[A-Z](?![A-Za-z])")
UPPER, LOWER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Shares of the classes in each encoding: the larger case, the other case and the rest.
CLASSES = {16: (6 / 16, 0, 10 / 16), 32: (26 / 32, 0, 6 / 32), 36: (26 / 36, 0, 10 / 36), 64: (26 / 64, 26 / 64, 12 / 64)}
#: Odds that a random run of n characters has the shape of words: (factor, base), factor * base ** n.
SHAPED = {16: (1.0, 6 / 16), 32: (1.0, 26 / 32), 36: (1.0, 26 / 36), 64: (0.26, 0.66)}
BAND = 10
BINS = 200
WIDTH = 0.5


def spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, hit, value) of the pattern's matches; ``value`` is group 1 where there is one."""
    group = 1 if "([" in pattern else 0
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    pieces = F.arrays_zip(hits.alias("hit"), values.alias("value"), gaps.alias("gap"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,hit:string,value:string>>").alias("out"))

    def step(acc, x):
        a = acc["at"] + x["gap"]
        b = a + F.length(x["hit"])
        one = F.struct(a.alias("start"), b.alias("end"), x["hit"].alias("hit"), x["value"].alias("value"))
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    only = F.filter(pieces, lambda x: x["hit"].isNotNull())
    found = F.aggregate(only, start, step, lambda acc: acc["out"])
    return F.when(text.rlike(pattern), found).otherwise(start["out"])


def _spans_of(kind: str, found: Column, least: int = 0) -> Column:
    kept = F.filter(found, lambda x: F.length(x["value"]) >= least) if least else found
    return F.transform(kept, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind) if kind in KINDS else 9).alias("rank"),
                                                x["end"].alias("end"), F.lit(kind).alias("kind")))


def encoding(s: Column) -> Column:
    """Size of the inferred alphabet: 16, 32, 36 or 64 characters."""
    return (F.when(s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(s.rlike("^[A-Z2-7]+$"), 32)
            .when(s.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 36).otherwise(64))


def _of(k: Column, values: dict[int, float]) -> Column:
    """The value of the encoding ``k``."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in (kv[0], float(kv[1]))]), k)


def _score(chi: Column, df: Column) -> Column:
    """Normal score of a chi-squared figure (Wilson-Hilferty); too even is no sign of words, so it counts upwards only."""
    z = (F.pow(F.greatest(chi, F.lit(0.0)) / df, F.lit(1 / 3)) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
    return F.greatest(z, F.lit(0.0))


def battery(s: Column, size: Column) -> Column:
    """Sum of the squared normal scores of the four tests; chi-squared with about four degrees for random text of an alphabet
    of ``size`` characters."""
    n = F.length(s).cast("double")
    k = size.cast("double")
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    counts = F.transform(F.array_distinct(chars), lambda c: n - F.length(F.replace(s, c, F.lit(""))))
    chi = F.aggregate(counts, F.lit(0.0), lambda a, c: a + c * c) * k / n - n

    classes = F.translate(s, UPPER + LOWER + DIGITS + "+/_-", "A" * 26 + "a" * 26 + "0" * 14)
    seen = [n - F.length(F.replace(classes, F.lit(c), F.lit(""))) for c in "Aa0"]
    shares = [_of(size, {e: x[i] for e, x in CLASSES.items()}) for i in range(3)]
    uneven = F.when(size == 64, sum((x - n * q) * (x - n * q) / (n * q) for x, q in zip(seen, CLASSES[64]))).otherwise(
        sum((x - n * q) * (x - n * q) / (n * q) for x, q in ((seen[0] + seen[1], shares[0]), (seen[2], shares[2]))))
    runs = F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(classes, "A+", "A"), "a+", "a"), "0+", "0")).cast("double")
    change = {e: 1 - sum(q * q for q in x) for e, x in CLASSES.items()}
    linked = {e: sum(q ** 3 for q in x) - sum(q * q for q in x) ** 2 for e, x in CLASSES.items()}
    p = _of(size, change)
    var = (n - 1) * p * (1 - p) + 2 * (n - 2) * _of(size, linked)
    z_change = (runs - 1 - (n - 1) * p) / F.sqrt(var)

    # Plain sums in one pass: an average inside a lambda would be taken anew for each character.
    def serial(a):
        mean, spread = a["sum"] / n, n * a["squares"] - a["sum"] * a["sum"]
        pairs = a["pairs"] - mean * (2 * a["sum"] - F.ascii(s) - a["last"]) + (n - 1) * mean * mean
        return F.when(spread > 0, (n * pairs / spread + 1 / n) * F.sqrt(n)).otherwise(F.sqrt(n))

    def step(a, c):
        x = F.ascii(c).cast("double")
        return F.struct(x.alias("last"), (a["sum"] + x).alias("sum"), (a["squares"] + x * x).alias("squares"), (a["pairs"] + x * a["last"]).alias("pairs"))

    z_serial = F.aggregate(chars, F.struct(*[F.lit(0.0).alias(x) for x in ("last", "sum", "squares", "pairs")]), step, serial)
    z_chi, z_classes = _score(chi, k - 1), _score(uneven, F.when(size == 64, 2.0).otherwise(1.0))
    return z_chi * z_chi + z_classes * z_classes + z_change * z_change + z_serial * z_serial


def _odds(s: Column, size: Column) -> Column:
    """Word-shaped runs to be expected for each random run of this encoding and length that is not."""
    a, b = (_of(size, {e: x[i] for e, x in SHAPED.items()}) for i in range(2))
    q = F.least(a * F.pow(b, F.length(s).cast("double")), F.lit(0.5))
    return q / (1 - q)


def _beyond(x: float) -> float:
    """Odds that chi-squared with four degrees exceeds ``x``."""
    return exp(-x / 2) * (1 + x / 2)


def _scan(rows: DataFrame, keep: str) -> DataFrame:
    """``keep`` with certain spans (base) and candidates with their place, band, whether they have the shape of words, the
    odds that a random one would, and the bin of the battery's figure, from the column ``t``."""
    base = F.concat(_spans_of("assign", spans(F.col("t"), ASSIGN), 12), _spans_of("access", spans(F.col("t"), ACCESS)),
                    _spans_of("hex", spans(F.col("t"), HEX)))
    found = F.transform(spans(F.col("t"), RANDOM), lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.rtrim(x["hit"], F.lit("=")).alias("s"),
        encoding(F.rtrim(x["hit"], F.lit("="))).alias("k")))
    judged = F.transform(F.col("found"), lambda x: F.struct(
        x["start"].alias("start"), x["end"].alias("end"),
        (x["k"] * 100 + F.least(F.floor(F.length(x["s"]) / BAND), F.lit(20))).cast("int").alias("band"),
        (~x["s"].rlike(UNLIKE)).alias("shaped"), _odds(x["s"], x["k"]).alias("odds"),
        F.least(F.floor(battery(x["s"], x["k"]) / WIDTH), F.lit(BINS - 1)).cast("int").alias("bin")))
    two = rows.select(keep, base.alias("base"), found.alias("found"))
    return two.select(keep, "base", F.when(F.size("found") > 0, judged).otherwise(
        F.array().cast("array<struct<start:int,end:int,band:int,shaped:boolean,odds:double,bin:int>>")).alias("candidates"))


def scanned(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base and candidates."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return _scan(docs.select(F.col(f"`{id_col}`").alias("doc_id"), t.alias("t")), "doc_id")


def bounds(scan: DataFrame, rate: float = RATE) -> DataFrame:
    """Per band the number of bins that count as random; at most one row per band."""
    bins = (scan.select(F.inline("candidates")).groupBy("band", "bin")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("shaped"), 1).otherwise(0)).alias("words"),
                 F.sum(F.when(F.col("shaped"), 0.0).otherwise(F.col("odds"))).alias("chance")))
    per = bins.groupBy("band").agg(F.array_sort(F.collect_list(F.struct("bin", "n", "words", "chance"))).alias("b"),
                                   F.sum("words").alias("n0"), F.sum("n").alias("n1"))
    total = lambda name, keep: F.aggregate(F.filter("b", keep), F.lit(0.0), lambda a, x: a + x[name])
    beyond = F.array(*[F.lit(_beyond(i * WIDTH)) for i in range(BINS)])
    places = F.transform("b", lambda x: x["bin"])
    # Benjamini-Hochberg: from the first of these bins on, runs are not random.
    rejected = F.filter(places, lambda i: F.element_at(beyond, i + 1) * F.col("n1") <= rate * total("n", lambda x: x["bin"] >= i))
    cut = F.coalesce(F.array_min(rejected), F.lit(BINS))

    def holds(i):
        chance = total("chance", lambda x: x["bin"] <= i)
        wrong = F.greatest(total("words", lambda x: x["bin"] <= i) - chance - 3 * F.sqrt(chance), F.lit(0.0))
        return wrong * F.col("n1") <= rate * total("n", lambda x: x["bin"] <= i) * F.greatest(F.col("n0"), F.lit(1))

    ok = F.filter(F.filter(places, lambda i: i < F.col("cut")), holds)
    return per.withColumn("cut", cut).select("band", F.coalesce(F.array_max(ok) + 1, F.lit(0)).alias("bins"))


def _settled(scan: DataFrame, limits: DataFrame, keep: str) -> DataFrame:
    """``keep``, base and spans, once the bounds are known."""
    kept = F.broadcast(limits.agg(F.map_from_entries(F.collect_list(F.struct("band", "bins"))).alias("bins")))
    found = F.filter("candidates", lambda x: (x["bin"] < F.coalesce(F.try_element_at(F.col("bins"), x["band"]), F.lit(0)))
                     & ~F.exists("base", lambda y: (y["start"] < x["end"]) & (x["start"] < y["end"])))
    random = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), x["end"].alias("end"),
                                                   F.lit("random").alias("kind")))
    return scan.crossJoin(kept).select(keep, F.array_sort("base").alias("base"), F.array_sort(F.concat("base", random)).alias("spans"))


def secrets(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rate: float = RATE) -> DataFrame:
    """doc_id, base and spans: arrays of (start, rank, end, kind), by start and then kind; base spans are among spans.

    A random span that touches a base span adds nothing and is left out.
    """
    scan = stored(scanned(docs, id_col, text), "secret-scan")
    return _settled(scan, bounds(scan, rate), "doc_id")


def masked(docs: DataFrame, text: str = "text", mask: str = "[SECRET]", rate: float = RATE) -> DataFrame:
    """``docs``, same columns, with every secret span of the text replaced; touching spans are replaced as one.

    Texts are scanned twice, once for the bounds and once in place, rather than carried through a shuffle.
    """
    c = F.col(f"`{text}`")
    limits = bounds(_scan(docs.select(F.lit(0).alias("k"), F.coalesce(c, F.lit("")).alias("t")), "k"), rate)
    packed = docs.select(F.struct(F.struct("*").alias("row"), F.coalesce(c, F.lit("")).alias("t")).alias("p"), F.coalesce(c, F.lit("")).alias("t"))
    got = _settled(_scan(packed, "p"), limits, "p").select("p.row", "p.t", "spans")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, x):
        gap = F.when(x["start"] >= acc["at"], F.concat(F.substr(F.col("t"), acc["at"] + 1, x["start"] - acc["at"]), F.lit(mask))).otherwise("")
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], gap).alias("out"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substr(F.col("t"), acc["at"] + 1, F.length("t"))))
    fields = [F.col(f"row.`{x}`") if x != text else F.when(F.size("spans") > 0, clean).otherwise(F.col(f"row.`{x}`")).alias(x) for x in docs.columns]
    return got.select(*fields)


def named(spans_col: str) -> Column:
    return F.array_join(F.transform(spans_col, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
