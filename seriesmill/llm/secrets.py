"""Secret scans: fixed patterns, and a randomness test battery under false-discovery control.

Everything is SQL functions.  Spans are ``(kind, start, end)`` in code points,
end exclusive, within one text.

The battery looks at every run of 24 or more characters that may encode bytes.
Its encoding is the smallest alphabet that holds it (hexadecimal, base32, base36 or base64) and
six tests ask whether it could be uniform draws from that alphabet: a
chi-squared test of the slices of it the symbols fall into, a runs test
about the middle of the alphabet, a lag-one serial correlation, and the numbers of
the letters that are common in words, of the marks that join them and of the letters of one case.  Their
p-values are joined to one by Bonferroni.  Prose and identifiers fail at least
one of them the more clearly the longer they are, so Benjamini-Hochberg's
procedure over all runs of similar length in the table declares runs *not
random*; what it does not declare is reported as a span of kind ``random``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import materialize

#: The base patterns.  A leading (?i) holds for the key words;
#: the value's class has letters of either case already.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")

#: The battery: shortest run, and the FDR at which runs are declared not random.
MIN_RUN = 24
RUN = r"[A-Za-z0-9+/_-]{%d,}" % MIN_RUN
FDR = 0.01
#: Runs of these lengths and more are controlled together, band by band.
BANDS = (24, 32, 40, 64, 128)
#: p-values are counted in bins of -log10(p) of this width, up to MAX_BIN.
BIN, MAX_BIN = 0.02, 2000

SPAN = "struct<start:int,end:int,rank:int>"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
BASE36 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
UUID = "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
#: Three of four letters of English text; in none of the alphabets more than a third.
COMMON = "etaoinsrhl"


def _no_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


#: Elements of an array that are folded at a time.
CHUNK = 256


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, start: Column, join) -> Column:
    """What ``join`` makes of all values before each one, beginning with ``start``; one more at the end, of all.

    Values are folded a chunk at a time from where the chunks before it end, so the work is that of
    the values (and of the square of the chunks), not of their square.
    """
    fold = lambda xs, first: F.aggregate(xs, F.array(first), lambda out, x: F.concat(out, F.array(join(F.element_at(out, -1), x))))

    def chunked(xs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(xs) / CHUNK).cast("int") - 1, F.lit(0))), lambda i: F.slice(xs, i * CHUNK + 1, F.lit(CHUNK)))
        return _let(chunks, lambda cs: _let(fold(F.transform(cs, lambda c: F.aggregate(c, start, join)), start), lambda firsts: _whole(cs, firsts)))

    def _whole(cs: Column, firsts: Column) -> Column:
        inner = F.zip_with(cs, F.slice(firsts, F.lit(1), F.size(cs)), lambda c, first: F.slice(fold(c, first), F.lit(1), F.size(c)))
        return F.concat(F.flatten(inner), F.slice(firsts, F.lit(-1), F.lit(1)))

    return _let(values, chunked)


def _located(df: DataFrame, name: str, pattern: str, rank: int, least: int, group: int = 0, hint: str | None = None, texts: bool = False) -> DataFrame:
    """Adds ``name``: spans of the matches whose ``group`` has ``least`` characters, with the match itself as ``run`` if asked for.

    A match starts where the pieces and matches before it end.  ``hint`` is a
    cheaper pattern that every text with such a match has.
    """
    p, many = F.lit(pattern), F.char_length
    has = F.col("_text").rlike(hint or pattern)
    df = df.withColumn("_m", F.when(has, F.regexp_extract_all("_text", p, F.lit(0))))
    df = df.withColumn("_v", F.when(F.col("_m").isNotNull(), F.transform(F.regexp_extract_all("_text", p, F.lit(group)), lambda x: many(x)) if group else F.transform("_m", lambda x: many(x))))
    df = df.withColumn("_gap", F.when(F.col("_m").isNotNull(), F.transform(F.split("_text", pattern, -1), lambda x: many(x))))
    # A gap and the match after it end where the next gap starts.
    steps = F.zip_with(F.slice("_gap", F.lit(1), F.size("_m")), F.transform("_m", lambda x: many(x)), lambda g, n: g + n)
    df = df.withColumn("_end", F.when(F.size("_m") > 0, F.slice(_running(steps, F.lit(0), lambda x, y: x + y), F.lit(2), F.size("_m"))))
    extra = [F.col("_m").alias("run")] if texts else []
    zipped = F.arrays_zip(F.col("_end").alias("e"), F.transform("_m", lambda x: many(x)).alias("n"), F.col("_v").alias("v"), *extra)
    wanted = F.filter(zipped, lambda x: x["v"] >= least)
    spans = F.transform(wanted, lambda x: F.struct((x["e"] - x["n"]).alias("start"), x["e"].alias("end"), F.lit(rank).alias("rank"), *([x["run"].alias("run")] if texts else [])))
    none = _no_spans() if not texts else F.array().cast("array<struct<start:int,end:int,rank:int,run:string>>")
    return df.withColumn(name, F.when(F.size("_m") > 0, spans).otherwise(none)).drop("_m", "_v", "_gap", "_end")


def base_spans(docs: DataFrame, text_col: str) -> DataFrame:
    """Adds ``_text`` (null as empty) and the spans ``_assign``, ``_access`` and ``_hex``."""
    df = docs.withColumn("_text", F.coalesce(text_col, F.lit("")))
    df = _located(df, "_assign", ASSIGN, 0, MIN_ASSIGN, 2, r"(?i:d|t|n|y)[\"']?\x20*[:=]")
    df = _located(df, "_access", ACCESS, 1, MIN_ACCESS)
    # A run of MIN_HEX characters starts where its maximal run starts.
    return _located(df, "_hex", r"[0-9a-f]{%d,}" % MIN_HEX, 2, MIN_HEX)


def _normal_tail(z: Column) -> Column:
    """P(|Z| > |z|) by Abramowitz and Stegun 26.2.17 (error under 1.5e-7), and the
    leading term of the tail beyond 5."""
    x = F.abs(z)
    t = 1 / (1 + 0.2316419 * x)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    density = F.exp(-x * x / 2) / 2.5066282746310002
    return F.least(F.lit(1.0), F.greatest(F.lit(1e-39), 2 * F.when(x < 5, density * poly).otherwise(density / x * (1 - 1 / (x * x)))))


def _symbols(run: Column, kind: Column) -> Column:
    """The places of the run's characters in its alphabet."""
    chars = F.split(run, "")
    hexes = F.transform(chars, lambda c: F.instr(F.lit("0123456789abcdef"), F.lower(c)) - 1)
    b32 = F.transform(chars, lambda c: F.instr(F.lit(BASE32), F.upper(c)) - 1)
    b36 = F.transform(chars, lambda c: F.instr(F.lit(BASE36), F.upper(c)) - 1)
    b64 = F.transform(chars, lambda c: F.instr(F.lit(BASE64), F.translate(c, "-_", "+/")) - 1)
    return F.when(kind == 16, hexes).when(kind == 32, b32).when(kind == 36, b36).otherwise(b64)


def battery(df: DataFrame, run: str) -> DataFrame:
    """Adds ``size`` (of the smallest alphabet that holds the run) and ``p``.

    Hexadecimal, base32 (letters and digits 2-7) and base36 have letters of one case;
    anything else is base64.  The dashes of a UUID are left out.  No run is passed over: words,
    paths and numbers are for the tests to tell.  They take the mean rank and grouping of symbols
    whose distributions under uniform draws are known, so no table is needed.
    """
    c = F.col(run)
    c = F.when(c.rlike(UUID), F.lower(F.translate(c, "-", ""))).otherwise(c)
    kind = F.when(c.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16).when(c.rlike("^([A-Z2-7]+|[a-z2-7]+)$"), 32).when(c.rlike("^([0-9A-Z]+|[0-9a-z]+)$"), 36).otherwise(64)
    df = df.withColumn("size", kind).withColumn("_x", _symbols(c, F.col("size")))
    n, k = F.size("_x").cast("double"), F.col("size").cast("double")
    # Chi-squared over at most n / 6 equal slices of the alphabet, 4 to 16 of them.
    df = df.withColumn("_cells", F.least(F.lit(16), F.col("size"), F.when(n >= 96, F.when(F.col("size") == 36, 12).otherwise(16)).when(n >= 48, F.when(F.col("size") == 36, 6).otherwise(8)).otherwise(4)))
    cells = F.col("_cells").cast("double")
    cell = F.transform("_x", lambda x: F.floor(x * F.col("_cells") / F.col("size")).cast("int"))
    df = df.withColumn("_cell", cell)
    squares = F.aggregate(F.sequence(F.lit(0), F.col("_cells") - 1), F.lit(0.0), lambda a, j: a + F.pow(F.size(F.filter("_cell", lambda x: x == j)).cast("double"), F.lit(2.0)))
    df = df.withColumn("_chi", squares * cells / n - n)
    free = cells - 1
    z_chi = (F.cbrt(F.greatest(F.col("_chi"), F.lit(0.0)) / free) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    # One-sided: only too uneven counts speak against uniform draws.
    p_chi = F.when(z_chi > 0, _normal_tail(z_chi) / 2).otherwise(1 - _normal_tail(z_chi) / 2)
    half = F.transform("_x", lambda x: x * 2 >= F.col("size"))
    df = df.withColumn("_half", half)
    changes = F.aggregate(F.zip_with(F.slice("_half", F.lit(1), F.size("_half") - 1), F.slice("_half", F.lit(2), F.size("_half") - 1), lambda x, y: (x != y).cast("int")), F.lit(0), lambda a, x: a + x)
    # Changes between neighbours are fair coin flips under uniform draws.
    z_runs = (changes - (n - 1) / 2) / F.sqrt((n - 1) / 4)
    mid = (k - 1) / 2
    products = F.aggregate(F.zip_with(F.slice("_x", F.lit(1), F.size("_x") - 1), F.slice("_x", F.lit(2), F.size("_x") - 1), lambda x, y: (x - mid) * (y - mid)), F.lit(0.0), lambda a, x: a + x)
    # Products of independent centred symbols have mean 0 and variance var ** 2.
    z_serial = products / (F.sqrt(n - 1) * (k * k - 1) / 12)
    # One-sided: words have more of the common letters than uniform draws.  Of hexadecimal two only: no test.
    common = n - F.char_length(F.translate(F.lower(c), COMMON, ""))
    share = len(COMMON) / k * F.when(k == 64, 2).otherwise(1)
    z_common = (common - 0.5 - n * share) / F.sqrt(n * share * (1 - share))
    p_common = F.when((k > 16) & (z_common > 0), _normal_tail(z_common) / 2).otherwise(1.0)
    # One-sided: paths and joined words have more of the two symbols past letters and digits than uniform draws.
    marks = F.size(F.filter("_x", lambda x: x >= 62)).cast("double")
    z_marks = (marks - 0.5 - n / 32) / F.sqrt(n / 32 * (1 - 1 / 32))
    p_marks = F.when((k == 64) & (z_marks > 0), _normal_tail(z_marks) / 2).otherwise(1.0)
    # One-sided for the commoner of two cases: joined names have one.
    case = F.greatest(F.size(F.filter("_x", lambda x: x < 26)), F.size(F.filter("_x", lambda x: (x >= 26) & (x < 52)))).cast("double")
    z_case = (case - 0.5 - n * 26 / 64) / F.sqrt(n * 26 / 64 * 38 / 64)
    p_case = F.when((k == 64) & (z_case > 0), _normal_tail(z_case)).otherwise(1.0)
    p = F.least(F.lit(1.0), 6 * F.least(p_chi, _normal_tail(z_runs), _normal_tail(z_serial), p_common, p_marks, p_case))
    return df.withColumn("p", p).drop("_x", "_cells", "_cell", "_chi", "_half")


def _bin(p: Column) -> Column:
    return F.least(F.lit(MAX_BIN), F.floor(-F.log10(p) / BIN)).cast("int")


def _band(length: Column) -> Column:
    return sum(((length >= b).cast("int") for b in BANDS[1:]), F.lit(0))


def not_random_bins(runs: DataFrame) -> DataFrame:
    """``(band, cut)``: p-values in bins of ``cut`` and above are declared not random.

    Benjamini-Hochberg within each length band, over counts per bin: the largest
    p-value p with p <= FDR * (runs with p-values up to p) / (all runs).
    """
    counts = runs.groupBy("band", "bin").agg(F.count(F.lit(1)).alias("n"))
    per_band = counts.groupBy("band").agg(F.array_sort(F.collect_list(F.struct((-F.col("bin")).alias("b"), "n"))).alias("bins"), F.sum("n").alias("all"))
    start = F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("cut"))

    def step(a, x):
        seen = a["seen"] + x["n"]
        # The bin's largest p-value stands for all of it.
        passes = F.pow(F.lit(10.0), x["b"] * BIN) <= F.lit(FDR) * seen / F.col("all")
        return F.struct(seen.alias("seen"), F.when(passes, -x["b"]).otherwise(a["cut"]).alias("cut"))

    return per_band.select("band", F.aggregate("bins", start, step, lambda a: a["cut"]).alias("cut"))


def find_secrets(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``(id, *keep, assign, access, hex, random)`` for every row: arrays of spans.

    Null texts count as empty; an empty table gives an empty table; null and
    repeated ids are rows of their own.  The texts are read once and never
    shuffled: spans and runs are written to the shared folder with a number for
    each row, and only the runs are tested and joined back.  What
    is gathered from the whole table is counts per length band and bin of the
    p-value, a fixed number of rows.  ``random`` holds the runs that are not
    declared not random, without those inside a base span.
    """
    kept = F.struct(*[F.col(c).alias(c) for c in dict.fromkeys([id_col, *keep])])
    df = base_spans(docs.select(kept.alias("_kept"), F.col(text_col).alias("_given")), "_given")
    df = _located(df, "_runs", RUN, KINDS.index("random"), MIN_RUN, texts=True)
    found = materialize(df.select(F.monotonically_increasing_id().alias("_row"), "_kept", "_assign", "_access", "_hex", "_runs"), "spans")
    # A run lies in a base span if the furthest end of those that start no later is no nearer than its own.
    base = F.transform(F.concat("_assign", "_access", "_hex"), lambda x: F.struct(x["start"], x["end"], F.lit(None).cast("string").alias("run")))
    runs = F.transform("_runs", lambda x: F.struct(x["start"], x["end"], x["run"]))
    each = found.where(F.size("_runs") > 0).select("_row", F.inline(F.concat(base, runs)))
    reached = F.max(F.when(F.col("run").isNull(), F.col("end"))).over(Window.partitionBy("_row").orderBy("start"))
    each = each.withColumn("inside", F.coalesce(reached >= F.col("end"), F.lit(False))).where("run is not null")
    tested = battery(each, "run").withColumn("bin", _bin(F.col("p"))).withColumn("band", _band(F.col("end") - F.col("start")))
    tested = materialize(tested.select("_row", "start", "end", "inside", "band", "bin"), "runs")
    cuts = not_random_bins(tested)
    left = tested.join(cuts, "band", "left").where(~F.col("inside") & (F.col("cut").isNull() | (F.col("bin") < F.col("cut"))))
    span = F.struct(F.col("start"), F.col("end"), F.lit(KINDS.index("random")).alias("rank"))
    random = left.groupBy("_row").agg(F.array_sort(F.collect_list(span)).cast(f"array<{SPAN}>").alias("_random"))
    out = found.join(random, "_row", "left")
    return out.select(*[F.col("_kept")[c].alias(c) for c in (id_col, *keep)], F.col("_assign").alias("assign"), F.col("_access").alias("access"), F.col("_hex").alias("hex"), F.coalesce("_random", _no_spans()).alias("random"))


def span_list(*spans: str) -> Column:
    """``kind:start:end`` of all spans by start, then kind, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    ordered = F.array_sort(F.transform(F.concat(*spans), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by ``mark``.

    The text is cut in two steps, by many spans at a time and then by each: a character is not
    passed once for every span.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def cut(ss: Column) -> Column:
        reached = _running(F.transform(ss, lambda s: s["end"]), F.lit(0), lambda x, y: F.greatest(x, y))
        # What a mark takes the place of begins where no earlier span reaches; before it, the text from there.
        whole = F.zip_with(ss, F.slice(reached, F.lit(1), F.size(ss)), lambda s, r: F.struct(r.alias("from"), s["start"].alias("to")))
        gaps = F.filter(whole, lambda g, i: (g["to"] >= g["from"]) & ((i == 0) | (g["from"] > 0)))
        tail = F.struct(F.element_at(reached, -1).alias("from"), F.greatest(F.char_length(text), F.element_at(reached, -1)).alias("to"))
        return _let(F.concat(gaps, F.array(tail)), pieces)

    def pieces(gs: Column) -> Column:
        chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size(gs) / CHUNK).cast("int") - 1), lambda i: F.slice(gs, i * CHUNK + 1, F.lit(CHUNK)))

        def of_chunk(c: Column) -> Column:
            first = F.element_at(c, 1)["from"]
            part = F.substring(text, first + 1, F.element_at(c, -1)["to"] - first)
            return _let(part, lambda t: F.transform(c, lambda g: F.substring(t, g["from"] - first + 1, g["to"] - g["from"])))

        return F.array_join(F.flatten(F.transform(chunks, of_chunk)), mark)

    return F.when(F.size(spans) > 0, _let(ordered, cut)).otherwise(text)
