"""Text, date and encoding functions of imaging catalogs as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import let

#: Sequence types in the order in which they are looked for.
SEQUENCES = ("LOCALIZER", "MPRAGE", "FSPGR", "SPGR", "BRAVO", "TFE", "FLAIR", "SSFSE", "STIR", "TIRM", "TSE", "FSE", "SWAN", "SWI", "DWI", "DTI", "ASL", "ADC", "GRE", "SE")
#: The weighting that a sequence type implies.
T1_SEQUENCES = ("MPRAGE", "BRAVO", "SPGR", "FSPGR", "TFE")
T2_SEQUENCES = ("FLAIR", "SSFSE", "STIR", "TIRM", "TSE", "FSE", "SWI", "SWAN")


def present(c: Column) -> Column:
    """c, or null where it is the empty string."""
    return F.nullif(c, F.lit(""))


def tokens(text: Column) -> Column:
    """Upper-case runs of letters and digits."""
    return F.filter(F.split(F.upper(text), "[^A-Z0-9]+"), lambda t: t != "")


def compact(text: Column) -> Column:
    return F.regexp_replace(F.upper(text), "[^A-Z0-9]", "")


def spaced(text: Column) -> Column:
    """The tokens with a blank around each: one string, so that tests on tokens are tests on a string."""
    return F.concat(F.lit(" "), F.regexp_replace(F.upper(text), "[^A-Z0-9]+", " "), F.lit(" "))


def any_prefix(words: Column, *prefixes: str) -> Column:
    return reduce(lambda found, p: found | words.contains(f" {p}"), prefixes, F.lit(False))


def any_numbered(words: Column, name: str) -> Column:
    """A token that is the name, with or without digits after it."""
    return words.contains(f" {name}") & words.rlike(f" {name}[0-9]* ")


def has_weight(words: Column, name: str) -> Column:
    """A token whose first occurrence of the name has no digit after it."""
    plain = lambda t: (F.instr(t, name) > 0) & ~F.substring(t, F.instr(t, name) + len(name), F.lit(1)).rlike("[0-9]")
    return words.contains(name) & F.exists(F.split(words, " "), plain)


def prepared(text: Column) -> Column:
    """What the rules on a text look at, computed once: struct of up (upper case), words (spaced tokens) and run (compacted)."""
    return F.struct(F.upper(text).alias("up"), spaced(text).alias("words"), compact(text).alias("run"))


def plane_in(p: Column) -> Column:
    up, words, run = p["up"], p["words"], p["run"]
    rules = [
        (up.contains("AXIAL"), "Axial"),
        (up.contains("CORONAL"), "Coronal"),
        (up.contains("SAGITTAL"), "Sagittal"),
        (any_prefix(words, "AX", "TRA ", "TRANS", "TRV"), "Axial"),
        (any_prefix(words, "COR"), "Coronal"),
        (any_prefix(words, "SAG"), "Sagittal"),
        (run.contains("SAG"), "Sagittal"),
        (run.contains("COR"), "Coronal"),
        (run.contains("AX") | run.contains("TRA") | run.contains("TRV"), "Axial"),
    ]
    return first_rule(rules)


def plane_of(text: Column) -> Column:
    """Axial, Coronal, Sagittal or null: long words, then tokens, then anything in the compacted text."""
    return let(prepared(text), plane_in)


def first_rule(rules: list[tuple[Column, str]]) -> Column:
    """The value of the first rule that holds, else null."""
    (test, value), *rest = rules
    return reduce(lambda chain, rule: chain.when(rule[0], rule[1]), rest, F.when(test, value))


def weight_in(words: Column) -> Column:
    return first_rule([(has_weight(words, w), w) for w in ("T1", "T2")])


def weight_of(text: Column) -> Column:
    return let(spaced(text), weight_in)


def sequence_in(p: Column) -> Column:
    found = lambda s: any_numbered(p["words"], s) | p["run"].contains(s) if len(s) > 3 else any_numbered(p["words"], s)
    return first_rule([(found(s), "Localizer" if s == "LOCALIZER" else s) for s in SEQUENCES])


def sequence_of(text: Column) -> Column:
    """The first known sequence type; names of over three letters also within the compacted text."""
    return let(prepared(text), sequence_in)


def implied_weight(sequence: Column) -> Column:
    return F.when(sequence.isin(*T1_SEQUENCES), "T1").when(sequence.isin(*T2_SEQUENCES), "T2")


def classified(text: Column) -> Column:
    """Struct of plane, weight (told, or implied by the sequence type) and sequence."""
    found = lambda p: F.struct(plane_in(p).alias("plane"), weight_in(p["words"]).alias("told"), sequence_in(p).alias("sequence"))
    shown = lambda f: F.struct(f["plane"].alias("plane"), F.coalesce(f["told"], implied_weight(f["sequence"])).alias("weight"), f["sequence"].alias("sequence"))
    return let(let(prepared(text), found), shown)


def joined(separator: str, *parts: Column) -> Column:
    """The non-empty parts, joined."""
    return F.array_join(F.filter(F.array(*parts), lambda x: present(x).isNotNull()), separator)


def classification_text(description: Column, protocol: Column, sequence: Column) -> Column:
    return joined(" | ", description, protocol, sequence)


def combo_id(plane: Column, weight: Column, sequence: Column) -> Column:
    return F.coalesce(present(F.regexp_replace(F.lower(joined("-", plane, weight, sequence)), r"\s+", "-")), F.lit("unknown"))


def combo_label(plane: Column, weight: Column, sequence: Column) -> Column:
    return F.coalesce(present(joined(" ", plane, weight, sequence)), F.lit("Unknown"))


def sequence_label(weight: Column, sequence: Column) -> Column:
    return F.coalesce(present(joined(" ", weight, sequence)), F.lit("Unknown"))


def iso_date(day: Column) -> Column:
    """yyyymmdd as yyyy-mm-ddT00:00:00; text of another length as it is. Not validated."""
    parts = F.concat_ws("-", F.substring(day, 1, 4), F.substring(day, 5, 2), F.substring(day, 7, 2))
    return F.when(F.length(day) == 8, F.concat(parts, F.lit("T00:00:00"))).otherwise(day)


def short_date(day: Column) -> Column:
    told = F.when(F.length(day) == 8, iso_date(day)).otherwise(day)
    return F.when(present(day).isNull(), "Unknown date").otherwise(F.substring_index(told, "T", 1))


def long_date(day: Column) -> Column:
    return F.coalesce(F.date_format(F.try_to_timestamp(day), "MMM d, yyyy"), F.lit("Unknown Date"))


def utc_millis(day: Column) -> Column:
    """Milliseconds of a strict y-m-d date, else null."""
    strict = F.when(day.rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$"), day)
    return F.unix_millis(F.try_to_timestamp(strict, F.lit("y-M-d")))


def rotation_text(degrees: Column) -> Column:
    """Two decimals at most, without trailing zeros."""
    return F.regexp_replace(F.regexp_replace(F.format_string("%.2f", degrees), r"\.00$", ""), r"(\.\d)0$", "$1")


def safe_filename(name: Column) -> Column:
    cleaned = F.substring(F.trim(F.regexp_replace(name, r'[\\/:"*?<>|]+', "_")), 1, 80)
    return F.coalesce(present(cleaned), F.lit("unknown"))


def zero_padded(number: Column, width: int) -> Column:
    """Padded to the width, never cut."""
    text = number.cast("string")
    return F.when(F.length(text) < width, F.lpad(text, width, "0")).otherwise(text)


def basename(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def number_list(text: Column) -> Column:
    """The finite numbers of a list separated by backslashes, commas or blanks; each by its longest numeric beginning."""
    leading = lambda x: F.regexp_extract(x, r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0).try_cast("double")
    return F.filter(F.transform(F.split(text, r"[\\,\s]+"), leading), lambda n: n.isNotNull() & ~F.isnan(n) & (F.abs(n) != float("inf")))


def tail(text: Column, n: int) -> Column:
    return F.right(text, F.lit(n))


def last_metric(out: Column, err: Column) -> Column:
    """Struct of final_metric and samples: the last number of each line that mentions a metric."""
    lines = F.filter(F.split(F.concat(out, F.lit("\n"), err), r"\r?\n"), lambda x: x.rlike("(?i)metric"))
    number = lambda x: F.try_element_at(F.regexp_extract_all(x, F.lit(r"([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)"), F.lit(1)), F.lit(-1)).try_cast("double")
    values = F.filter(F.transform(lines, number), lambda v: v.isNotNull())
    return F.struct(F.try_element_at(values, F.lit(-1)).alias("final_metric"), F.size(values).alias("samples"))


def uri_encoded(text: Column) -> Column:
    """Percent encoding, with blanks as %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def uri_decoded(text: Column) -> Column:
    """Decoded text, null if it is malformed."""
    return F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def import_problem(errors: Column, skipped: Column, first: Column) -> Column:
    """A sentence on an import that stored nothing, of the parts that apply."""
    return joined("; ", F.when(skipped > 0, F.concat(skipped.cast("string"), F.lit(" skipped"))), F.when(errors > 0, F.concat(errors.cast("string"), F.lit(" failed"))), F.when(present(first).isNotNull(), F.concat(F.lit("first error: "), first)))
