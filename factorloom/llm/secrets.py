"""Secret scans: three base patterns and a battery of randomness tests, DataFrame operations only.

The battery looks at tokens of 20 or more letters, digits and signs that may be
encoded bytes, and infers the narrowest encoding whose alphabet they keep to, from
hex to all of these symbols. Three tests ask whether a token could be such an encoding
of random bytes: chi-squared of its symbols against a uniform alphabet, the number of
runs of symbols of one class (capital, small, digit, sign), and the correlation of
neighbouring symbols. Under randomness each is a z of known mean and variance at any
length, and their sum z is nearly standard normal; ordinary text is uneven, stays in a
class and has alike neighbours, so its z is large and grows with the root of its length.

A token that is consistent with randomness is still no discovery if ordinary text would
be so too. A token's p-value is the chance that ordinary text of its length has so small
a z: ordinary text is normal around slope * sqrt(length). Slope and spread of each
encoding are fitted to the z of all tokens of the table (a mixture with the standard
normal law of random tokens, see ``calibrated``), and the adaptive Benjamini-Hochberg
rule then controls the share of false discoveries within each encoding and band of lengths.

Every step works within a row and in time proportional to its text, but for the counts
of (encoding, band, z), a table whose size does not grow with the data, on which the
driver fits and sets limits.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_name, stored, table

#: Kinds in the order that breaks ties of starts.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
SMALL, DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings, narrowest first: alphabet in order of value, slope and spread of ordinary text before any data (of identifiers in Python's standard library).
ENCODINGS = {
    "hex": (DIGITS + "abcdef", 0.6, 1.1),
    "HEX": (DIGITS + "ABCDEF", 0.6, 1.1),
    "BASE32": (SMALL.upper() + "234567", 0.6, 1.1),
    "base32": (SMALL + "234567", 0.6, 1.1),
    "base36": (DIGITS + SMALL, 0.6, 1.1),
    "BASE36": (DIGITS + SMALL.upper(), 0.6, 1.1),
    "base64": (SMALL.upper() + SMALL + DIGITS + "+/", 1.05, 2.1),
    "base64url": (SMALL.upper() + SMALL + DIGITS + "-_", 1.05, 2.1),
    "mixed": (SMALL.upper() + SMALL + DIGITS + "+/-_", 1.05, 2.1),
}
ALPHABETS = [a for a, _, _ in ENCODINGS.values()]
RATE = 0.05
#: The z below which 99.9 % of random tokens lie.
CONSISTENT = 3.09
STEPS = 8  # bins of z in one unit
BLOCK = 128
PIECE = 1024


def let(value: Column, f) -> Column:
    """f(value), with value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def running(xs: Column, zero: Column, op) -> Column:
    """What op, which is associative, makes of each element and those before it; copies grow with the elements and not their square."""

    def scan(part):
        return F.aggregate(part, F.struct(zero.alias("at"), F.slice(F.array(zero), 1, 0).alias("all")), lambda d, x: let(op(d["at"], x), lambda a: F.struct(a.alias("at"), F.concat(d["all"], F.array(a)).alias("all"))))

    def joined(parts):
        before = F.aggregate(parts, F.struct(zero.alias("at"), F.slice(F.array(zero), 1, 0).alias("all")), lambda d, p: F.struct(op(d["at"], p["at"]).alias("at"), F.concat(d["all"], F.array(d["at"])).alias("all")), lambda d: d["all"])
        return F.flatten(F.zip_with(parts, before, lambda p, b: F.transform(p["all"], lambda x: op(b, x))))

    def whole(xs):
        cuts = F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / BLOCK).cast("int"))
        return F.when(F.size(xs) > 0, let(F.transform(cuts, lambda k: scan(F.slice(xs, k * BLOCK + 1, F.lit(BLOCK)))), joined)).otherwise(F.slice(F.array(zero), 1, 0))

    return let(xs, whole)


def matches(text: Column, pattern: str) -> Column:
    """(start, end, hit) of each leftmost non-overlapping match, in code points.

    What split leaves between the matches tells where they are.
    """
    none = F.array().cast("array<struct<start:int,end:int,hit:string>>")

    def placed(hits, gaps):
        ends = running(F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.length(h) + F.length(g)), F.lit(0), lambda a, b: a + b)
        return F.zip_with(hits, ends, lambda h, e: F.struct((e - F.length(h)).alias("start"), e.alias("end"), h.alias("hit")))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: let(F.split(text, pattern, -1), lambda gaps: placed(hits, gaps)))
    return F.when(F.regexp_like(text, F.lit(pattern)), found).otherwise(none)


def free_tokens(base: Column, tokens: Column) -> Column:
    """The tokens that no base span overlaps; both are ordered by start."""
    far = F.lit((1 << 31) - 1)

    def apart(spans):
        ended = running(F.transform(spans, lambda x: F.when(x["kind"] < 3, x["end"]).otherwise(0)), F.lit(0), F.greatest)
        begins = F.reverse(running(F.reverse(F.transform(spans, lambda x: F.when(x["kind"] < 3, x["start"]).otherwise(far))), far, F.least))
        told = F.zip_with(F.zip_with(spans, ended, lambda x, e: F.struct(x.alias("x"), e.alias("e"))), begins, lambda y, b: F.struct(y["x"].alias("x"), ((y["x"]["kind"] == 3) & (y["e"] <= y["x"]["start"]) & (b >= y["x"]["end"])).alias("free")))
        return F.transform(F.filter(told, lambda y: y["free"]), lambda y: F.struct(y["x"]["start"].alias("start"), y["x"]["end"].alias("end"), y["x"]["hit"].alias("hit")))

    spans = F.array_sort(F.concat(F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["kind"].alias("kind"), b["end"].alias("end"), F.lit("").alias("hit"))), F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end"), t["hit"].alias("hit")))))
    return F.when((F.size(base) == 0) | (F.size(tokens) == 0), tokens).otherwise(let(spans, apart))


def class_of(symbol: str) -> str:
    return "A" if symbol.isupper() else "a" if symbol.islower() else "0" if symbol.isdigit() else "-"


def expected(alphabet: str) -> tuple[float, float, float, float]:
    """Of random symbols: how many there are; the chance that two neighbours differ in class, and the covariance of that of a pair and the next one; that of a pair's likeness with its change of class."""
    m, places = len(alphabet), defaultdict(list)
    for value, symbol in enumerate(alphabet):
        places[class_of(symbol)].append(value)
    share = {k: len(v) / m for k, v in places.items()}
    change = 1 - sum(p * p for p in share.values())
    after = sum(p * (1 - p) ** 2 for p in share.values()) - change**2
    alike = sum((share[k] * (sum(v) / len(v) - (m - 1) / 2)) ** 2 for k, v in places.items())
    return float(m), change, after, alike


def encoding_of(body: Column) -> Column:
    """The place in ENCODINGS of the narrowest alphabet that has all symbols."""
    out = F.lit(len(ALPHABETS) - 1)
    for k in range(len(ALPHABETS) - 2, -1, -1):
        out = F.when(body.rlike(f"^[{ALPHABETS[k].replace('-', '') + ('-' if '-' in ALPHABETS[k] else '')}]+$"), k).otherwise(out)
    return out


def tested(hit: Column) -> Column:
    """The battery on one token: encoding (its place), n, z_uniform, z_runs, z_serial, z; the z are of one side, large for ordinary text."""
    pick = lambda values, e: F.get(F.array(*[F.lit(x) for x in values]), e)
    m_, change_, after_, alike_ = zip(*map(expected, ALPHABETS), strict=True)

    def measured(body, e, alphabet):
        n, m = F.length(body).cast("double"), pick(m_, e)
        squares = F.aggregate(F.split(alphabet, ""), F.lit(0.0), lambda t, c: t + F.pow(n - F.length(F.replace(body, c, F.lit(""))), F.lit(2.0)))
        uniform = (m / n * squares - n - (m - 1)) / F.sqrt(2 * (m - 1) * (n - 1) / n)
        classes = F.translate(body, SMALL.upper() + SMALL + DIGITS + "+/-_", "A" * 26 + "a" * 26 + "0" * 10 + "-" * 4)
        changes = F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1
        spread = F.sqrt((n - 1) * pick(change_, e) * (1 - pick(change_, e)) + 2 * (n - 2) * pick(after_, e))
        runs = ((n - 1) * pick(change_, e) - changes) / spread
        values = F.transform(F.split(body, ""), lambda c: F.instr(alphabet, c) - 1 - (m - 1) / 2)
        products = let(values, lambda v: F.aggregate(F.zip_with(F.slice(v, 2, F.size(v)), F.slice(v, 1, F.size(v) - 1), lambda a, b: a * b), F.lit(0.0), lambda t, x: t + x))
        serial = products / (F.sqrt(n - 1) * (m * m - 1) / 12)
        both = F.sqrt(n - 1) * pick(alike_, e) / (spread * (m * m - 1) / 12)
        three = F.struct(uniform.alias("u"), runs.alias("r"), serial.alias("s"), both.alias("b"))
        z = lambda x: F.struct(e.alias("encoding"), n.cast("int").alias("n"), x["u"].alias("z_uniform"), x["r"].alias("z_runs"), x["s"].alias("z_serial"), ((x["u"] + x["r"] + x["s"]) / F.sqrt(3 + 2 * x["b"])).alias("z"))
        return let(three, z)

    return let(F.rtrim(hit, F.lit("=")), lambda body: let(encoding_of(body), lambda e: let(pick(ALPHABETS, e), lambda alphabet: measured(body, e, alphabet))))


def band_of(n):
    """Bands of lengths end at 24, 32, 48, 64, ..."""
    return F.floor(F.log2(n / F.lit(16.0)) * 2).cast("int")


def step_of(z):
    """The bin of z: that of an upper edge step / STEPS."""
    return F.least(F.lit(64 * STEPS), F.greatest(F.lit(-16 * STEPS), F.ceil(z * STEPS))).cast("int")


def normal_cdf(z: float) -> float:
    return math.erfc(-z / math.sqrt(2)) / 2


def calibrated(cells, rounds: int = 60, weight: float = 50.0) -> dict[int, tuple[float, float, dict[int, float]]]:
    """(slope, spread, share by band) of ordinary text by encoding, from cells (encoding, band, step, count, root of the least length).

    Expectation maximisation for a mixture of random tokens, N(0, 1), and ordinary
    ones, N(slope * root, spread), whose shares each band has of its own; the values
    before any data count as ``weight`` tokens of 24 symbols.
    """
    out = {}
    for k, (_, slope0, spread0) in enumerate(ENCODINGS.values()):
        own = [(band, (step - 0.5) / STEPS, root, count) for e, band, step, count, root in cells if e == k]
        slope, spread, share = slope0, spread0, defaultdict(lambda: 0.5)
        for _ in range(rounds if own else 0):
            top, bottom, ordinary, squares = weight * 24 * slope0, weight * 24.0, weight, weight * spread0**2
            held, mass, every = [], defaultdict(float), defaultdict(int)
            for band, z, root, count in own:
                a = math.log(1 - share[band]) - z * z / 2
                b = math.log(share[band]) - ((z - slope * root) / spread) ** 2 / 2 - math.log(spread)
                g = count / (1 + math.exp(min(700.0, a - b)))
                held.append(g)
                top, bottom, ordinary = top + g * root * z, bottom + g * root * root, ordinary + g
                mass[band], every[band] = mass[band] + g, every[band] + count
            slope = max(0.5 * slope0, top / bottom)
            squares += sum(g * (z - slope * root) ** 2 for g, (_, z, root, _) in zip(held, own, strict=True))
            spread = max(0.75 * spread0, math.sqrt(squares / ordinary))
            share = {x: (mass[x] + 1) / (every[x] + 2) for x in every}
        out[k] = (slope, spread, dict(share))
    return out


def limits_of(cells, rate: float = RATE) -> dict[tuple[int, int], int]:
    """The largest step that the Benjamini-Hochberg rule discovers, by (encoding, band).

    The rule is the adaptive one, which knows the share of ordinary tokens in the
    group. A bin counts as its largest p-value.
    """
    laws, groups = calibrated(cells), defaultdict(list)
    for e, band, step, count, root in cells:
        groups[e, band].append((step, count, root))
    out = {}
    for (e, band), rows in groups.items():
        (slope, spread, share), every, upto = laws[e], sum(c for _, c, _ in rows), 0
        for step, count, root in sorted(rows):
            upto += count
            if step / STEPS <= CONSISTENT and share[band] * normal_cdf((step / STEPS - slope * root) / spread) <= rate * upto / every:
                out[e, band] = step
    return out


def cells_of(marked: DataFrame, tokens: str) -> list[tuple]:
    """Tokens counted by encoding, band and step, over all rows: at most some ten thousand cells, however many tokens."""
    rows = marked.where(F.size(tokens) > 0).select(F.explode(tokens).alias("t")).groupBy("t.encoding", "t.band", "t.step").agg(F.count("*").alias("c"), F.sqrt(F.min("t.n")).alias("root"))
    return sorted((r["encoding"], r["band"], r["step"], r["c"], r["root"]) for r in rows.collect())


def discovered(tokens: Column, limits: dict[tuple[int, int], int]) -> Column:
    """Spans of the tokens at or below their group's limit."""
    if limits:
        least = F.create_map(*[F.lit(x) for (e, band), step in sorted(limits.items()) for x in (e * 1000 + band, step)])
        tokens = F.filter(tokens, lambda t: F.coalesce(t["step"] <= F.element_at(least, t["encoding"] * 1000 + t["band"]), F.lit(False)))
    else:
        tokens = F.slice(tokens, 1, 0)
    return F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end")))


def _kept(found: Column, kind: int, least=None) -> Column:
    spans = F.filter(found, least) if least else found
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def scanned(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """(df, stored, of its columns those to keep, and all spans in order; the spans' name).

    Spans are (start, kind, end), kind a place in KINDS. Null texts count as empty.
    Whole texts are scanned. A token of the battery that a base span overlaps is that span's.
    """
    base, tokens, spans = (own_name(df, x) for x in ("base", "tokens", "spans"))
    keep = df.columns if keep is None else keep
    text = F.coalesce(F.col(text_col), F.lit(""))
    group = lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 12
    first = df.withColumn(base, F.array_sort(F.concat(_kept(matches(text, ASSIGN), 0, group), _kept(matches(text, ACCESS), 1), _kept(matches(text, HEX), 2))))
    first = first.withColumn(tokens, matches(text, TOKEN)).select(*keep, base, tokens)

    def marked(t):
        about = lambda x: F.struct(t["start"].alias("start"), t["end"].alias("end"), x["encoding"].alias("encoding"), x["n"].alias("n"), band_of(x["n"]).alias("band"), step_of(x["z"]).alias("step"))
        return let(tested(t["hit"]), about)

    first = first.withColumn(tokens, F.when(F.size(tokens) > 0, F.transform(free_tokens(F.col(base), F.col(tokens)), marked)))
    first = stored(first, "secret-spans")
    found = discovered(F.col(tokens), limits_of(cells_of(first, tokens)))
    both = F.when(F.size(tokens) > 0, F.array_sort(F.concat(base, found))).otherwise(F.col(base))
    return first.withColumn(spans, both).drop(base, tokens), spans


def told(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    name = lambda k: F.get(F.array(*[F.lit(x) for x in KINDS]), k)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s["kind"]), s["start"], s["end"])), ",")


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of df: id_col, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no span: zeros, the hash of nothing, an empty string.
    Repeated rows and null ids stay; an empty table gives an empty result; a text of
    any length is scanned whole, in time and memory proportional to it and its spans.
    Columns other than the two named are not read.
    """
    slim = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found, spans = scanned(slim, "text", ["id"])
    s = F.col(spans)
    count = lambda k: F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long")
    base = F.filter(s, lambda x: x["kind"] < 3)
    return found.select(F.col("id").alias(id_col), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(s).alias("spans"))


def masked(text: Column, spans: Column, mask: str) -> Column:
    """text with the spans, which are ordered by start, replaced; of overlapping ones the whole. The text is cut in pieces once, so that a span's cost does not grow with the text."""

    def between(pieces, a, b):
        some = F.array_join(F.slice(pieces, F.floor(a / PIECE).cast("int") + 1, (F.floor(b / PIECE) - F.floor(a / PIECE)).cast("int") + 1), "")
        return F.substring(some, F.pmod(a, F.lit(PIECE)) + 1, b - a)

    def replaced(pieces, ended):
        last, before = F.element_at(ended, -1), F.concat(F.array(F.lit(0)), F.slice(ended, 1, F.size(ended) - 1))
        parts = F.zip_with(spans, before, lambda s, at: F.when(s["start"] >= at, F.concat(between(pieces, at, s["start"]), F.lit(mask))).otherwise(""))
        return F.concat(F.array_join(parts, ""), between(pieces, last, F.length(text)))

    ends = running(F.transform(spans, lambda s: s["end"]), F.lit(0), F.greatest)
    cut = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return let(cut, lambda pieces: let(ends, lambda ended: replaced(pieces, ended)))


def redact(df: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """df with every span of its texts replaced by mask; overlapping spans are one.

    Null texts stay null and empty ones empty; all rows and columns come back, whatever their names.
    """
    found, spans = scanned(df, text_col)
    return found.withColumn(text_col, F.when(F.size(spans) > 0, masked(F.col(text_col), F.col(spans), mask)).otherwise(F.col(text_col))).select(*df.columns)


def op6_secret_scan(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"))


def secret_base_counts(spark, sf_dir):
    """Of op6's rows what SQL can express."""
    return op6_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


COUNTS_SQL = r"""
SELECT doc_id,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1), lambda x: length(x) >= 12))::BIGINT AS n_assign,
  len(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]{14,}'))::BIGINT AS n_access,
  len(regexp_extract_all(coalesce(text, ''), '[0-9a-f]{16,}'))::BIGINT AS n_hex
FROM documents
"""
