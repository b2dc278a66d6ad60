"""Secrets in texts, in DataFrame operations: known forms, and strings of high Shannon entropy.

Positions of regular-expression matches come from splitting the text by the pattern: the pieces between
the matches and the matches themselves alternate, so sums of their lengths are starts and ends (in code
points, end exclusive). The sums are taken in a parallel scan of log2(n) passes, so a text with many
matches costs n * log(n). No pattern repeats a group, as Java's matcher recurses over those.

The entropy scan blanks the known forms out of the text (assignments, then access keys, then hex runs),
takes candidate strings (runs of WINDOW or more characters of the base64 and base64url alphabets) and
slides a window of WINDOW characters over each, in bounded pieces. The window keeps a count for every
character, five bits each in a few longs; as one enters and one leaves, two counts change, and the sum
of n * log2(n) changes by their terms alone. Windows at or over the threshold of the string's class (hex
or base64) are hot; the span runs from the first hot window to the end of the last, unless the string
or the span is on the allow-list.

Defined results: a null text is empty; texts without secrets have zero counts, an empty spans string
and the digest of the empty string; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64")

#: Fixed patterns of the known forms, with the least length that counts.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 6
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
#: First code of the alphabet, bits of a count, counts in a long and longs: '+' to 'z' are 80 codes.
FIRST_CODE, COUNT_BITS, PER_LONG, LONGS = 43, 5, 12, 7
#: Windows of a string that are scanned in one piece.
PIECE = 4096
#: Bits a character from which a window is hot.
HEX_BITS, BASE64_BITS = 3.0, 3.7
#: Strings that are no secrets: words joined by marks, with a number at most; numbers and dates; UUIDs; words joined by numbers of one or two digits.
ALLOWED_STRINGS = (r"^[A-Za-z+/_-]*[0-9]{0,6}$", r"^[0-9+/_-]*$", r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")
#: Spans that are no secrets: without a digit, or told to be examples.
ALLOWED_SPANS = (r"^[^0-9]*$", r"(?i)example|sample|placeholder|xxxx|changeme")

SPANS = "array<struct<start:int,end:int,match:string>>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is evaluated once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(values: Column) -> Column:
    """Sums of an array of ints up to and including each place: log2(n) passes, each over the whole array."""
    earlier = lambda acc, i, k: F.coalesce(F.get(acc, i - F.call_function("shiftleft", F.lit(1), k)), F.lit(0))
    passes = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(F.size(values), F.lit(2)))).cast("int") - 1)
    return F.aggregate(passes, values, lambda acc, k: F.transform(acc, lambda x, i: x + earlier(acc, i, k)))


def located(text: Column, pattern: str) -> Column:
    """Array of (start, end, match) of the leftmost non-overlapping matches."""

    def of(p: Column) -> Column:
        pieces = F.slice(F.split(p["text"], pattern, -1), F.lit(1), F.size(p["found"]))
        sizes = F.zip_with(pieces, p["found"], lambda piece, match: F.length(piece) + F.length(match))
        return F.zip_with(let(sizes, running), p["found"], lambda end, match: F.struct((end - F.length(match)).alias("start"), end.alias("end"), match.alias("match")))

    found = lambda t: let(F.struct(t.alias("text"), F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("found")), of)
    return let(text, lambda t: F.when(t.rlike(pattern), found(t)).otherwise(F.array().cast(SPANS)))


def blanked(text: Column, pattern: str, counts: Callable[[Column], Column] | None = None) -> Column:
    """The text with each match, that counts, as blanks."""
    hide = lambda match: F.repeat(F.lit(" "), F.length(match))
    shown = lambda m: F.when(counts(m), hide(m)).otherwise(m) if counts else hide(m)
    found = lambda t: F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    joined = lambda t: F.array_join(F.zip_with(F.split(t, pattern, -1), found(t), lambda piece, match: F.concat(piece, F.coalesce(shown(match), F.lit("")))), "")
    return let(text, lambda t: F.when(t.rlike(pattern), joined(t)).otherwise(t))


def told(spans: Column, kind: str) -> Column:
    """The spans as (start, kind number, end)."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s["end"].alias("end")))


def hot_piece(piece: Column, bits: Column) -> Column:
    """(first, end) of the stretch of hot windows in a piece of a string, first null if none is hot."""
    place = lambda c: F.struct(F.floor(c / PER_LONG).cast("int").alias("long"), (c % PER_LONG * COUNT_BITS).alias("shift"))
    codes = F.transform(F.filter(F.split(piece, ""), lambda c: c != ""), lambda c: let(F.ascii(c) - FIRST_CODE, place))
    weigh = lambda n: n * F.log2(F.greatest(n, F.lit(1)).cast("double"))
    zero = F.struct(F.array_repeat(F.lit(0).cast("long"), LONGS).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("i"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("end"))
    one = lambda code: F.call_function("shiftleft", F.lit(1).cast("long"), code["shift"])
    count = lambda counts, code: F.call_function("shiftright", F.get(counts, code["long"]), code["shift"]).bitwiseAND(F.lit(2**COUNT_BITS - 1)).cast("int")

    def moved(acc: Column, code: Column, gone: Column) -> Column:
        """The state after code has entered the window and gone, or null, has left it."""
        known = F.struct(count(acc["counts"], code).alias("n_in"), count(acc["counts"], gone).alias("n_out"), one(code).alias("add"), one(gone).alias("take"))

        def of(k: Column) -> Column:
            change = weigh(k["n_in"] + 1) - weigh(k["n_in"]) + F.coalesce(weigh(k["n_out"] - 1) - weigh(k["n_out"]), F.lit(0.0))
            counts = F.transform(acc["counts"], lambda n, i: n + F.when(i == code["long"], k["add"]).otherwise(F.lit(0)) - F.when(i == gone["long"], k["take"]).otherwise(F.lit(0)))
            return F.struct(counts.alias("counts"), (acc["sum"] + change).alias("sum"))

        return F.when(gone.eqNullSafe(code), F.struct(acc["counts"].alias("counts"), acc["sum"].alias("sum"))).otherwise(let(known, of))

    def judged(acc: Column, now: Column) -> Column:
        hot = (acc["i"] >= WINDOW - 1) & (F.log2(F.lit(float(WINDOW))) - now["sum"] / WINDOW >= bits - 1e-9)
        ends = lambda h: F.struct(now["counts"].alias("counts"), now["sum"].alias("sum"), (acc["i"] + 1).alias("i"), F.coalesce(acc["first"], F.when(h, acc["i"] - (WINDOW - 1))).alias("first"), F.when(h, acc["i"] + 1).otherwise(acc["end"]).alias("end"))
        return let(hot, ends)

    def scan(own: Column) -> Column:
        leaves = lambda acc: F.when(acc["i"] >= WINDOW, F.get(own, acc["i"] - WINDOW))
        step = lambda acc, code: let(let(leaves(acc), lambda gone: moved(acc, code, gone)), lambda now: judged(acc, now))
        return F.aggregate(own, zero, step, lambda acc: F.struct(acc["first"].alias("first"), acc["end"].alias("end")))

    return let(codes, scan)


def hot_stretch(match: Column, bits: Column) -> Column:
    """(first, end) from the first hot window of a string to the end of the last, null if none is hot."""
    data = match.cast("binary")  # one byte a character, and pieces of bytes are taken without counting characters
    at = F.sequence(F.lit(0), F.floor((F.length(match) - WINDOW) / PIECE).cast("int"))
    moved = lambda k: lambda h: F.struct((h["first"] + k * PIECE).alias("first"), (h["end"] + k * PIECE).alias("end"))
    pieces = F.transform(at, lambda k: let(hot_piece(F.substring(data, k * PIECE + 1, F.lit(PIECE + WINDOW - 1)).cast("string"), bits), moved(k)))
    return let(pieces, lambda p: F.struct(F.array_min(p.getField("first")).alias("first"), F.array_max(p.getField("end")).alias("end")))


def matches_any(text: Column, patterns: tuple[str, ...]) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in patterns))


def entropy_spans(candidates: Column) -> Column:
    """The hot stretches of candidate strings, as (start, kind number, end)."""
    of_kind = lambda kind, bits: F.struct(F.lit(KINDS.index(kind)).alias("kind"), F.lit(bits).alias("bits"))
    kind_of = lambda c: F.when(c["match"].rlike("^(?:[0-9a-f]*|[0-9A-F]*)$"), of_kind("entropy_hex", HEX_BITS)).otherwise(of_kind("entropy_base64", BASE64_BITS))
    suspect = F.filter(candidates, lambda c: ~matches_any(c["match"], ALLOWED_STRINGS))
    scanned = lambda c: lambda k: F.struct(c.alias("of"), k["kind"].alias("kind"), hot_stretch(c["match"], k["bits"]).alias("hot"))
    hot = F.transform(suspect, lambda c: let(kind_of(c), scanned(c)))
    shown = lambda h: F.substring(h["of"]["match"], h["hot"]["first"] + 1, h["hot"]["end"] - h["hot"]["first"])
    hot = F.filter(hot, lambda h: h["hot"]["first"].isNotNull() & ~matches_any(shown(h), ALLOWED_SPANS))
    return F.transform(hot, lambda h: F.struct((h["of"]["start"] + h["hot"]["first"]).alias("start"), h["kind"].alias("kind"), (h["of"]["start"] + h["hot"]["end"]).alias("end")))


def written(spans: Column) -> Column:
    """kind:start:end of the spans, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def counts_as_assign(match: Column) -> Column:
    return F.length(F.regexp_extract(match, ASSIGN, 2)) >= ASSIGN_LEAST


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs."""
    df = docs.select(docs["doc_id"], F.coalesce(docs["text"], F.lit("")).alias("text"))
    rest = blanked(blanked(blanked(F.col("text"), ASSIGN, counts_as_assign), ACCESS), HEX)
    assign = F.filter(located(F.col("text"), ASSIGN), lambda s: counts_as_assign(s["match"]))
    df = df.select("doc_id", assign.alias("assign"), located(F.col("text"), ACCESS).alias("access"), located(F.col("text"), HEX).alias("hex"), rest.alias("rest"))
    df = df.withColumn("strings", located(F.col("rest"), CANDIDATE))
    base = F.array_sort(F.concat(told(F.col("assign"), "assign"), told(F.col("access"), "access"), told(F.col("hex"), "hex")))
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    more = F.when(F.size("strings") > 0, entropy_spans(F.col("strings"))).otherwise(none)
    df = df.select("doc_id", "assign", "access", "hex", base.alias("base"), more.alias("more"))
    count = lambda c: F.size(c).cast("long")
    spans = F.array_sort(F.concat("base", "more"))
    return df.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(spans).alias("spans"))
