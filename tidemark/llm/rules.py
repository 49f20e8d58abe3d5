"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document; the ledger keeps the measurements and one failure bit per rule.
A policy is a named, versioned mask over those bits, so applying another policy, or asking what a rule alone
removes, reads the ledger and never the text again. DataFrame functions only.

Defined results: a null text has no words and fails ``few_words``; an empty table gives an empty ledger; repeated
rows each get their own ledger row; columns of the input other than the two named ones are ignored, so clashing
names do no harm.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES

#: The symbols counted by n_symbols.
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
#: White space that separates words, as in a pattern's brackets.
SPACE = r"\x20\x09-\x0D"
WINDOW = 8

#: Rule name -> its bit and the condition under which it fails, over the measurements.
RULES: dict[str, tuple[int, str]] = {
    "few_words": (0, "n_words < 20"),
    "repeated_windows": (1, "100 * n_repeat_words > 30 * n_words"),
    "symbol_heavy": (2, "100 * n_symbols > 8 * word_chars"),
    "duplicate_lines": (3, "n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines"),
    "shouting": (4, "100 * n_capitals > 40 * word_chars"),
    "word_length": (5, "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 25 * n_words)"),
    "exclaiming": (6, "100 * n_exclaims > 30 * n_words"),
    "stuttering": (7, "100 * n_stutters > 30 * n_words"),
}


def mask(*names: str) -> int:
    """The bits of the named rules."""
    return sum(1 << RULES[name][0] for name in names)


#: Policy version -> mask; a document is kept when it fails no rule of the mask. Old versions stay for comparison.
POLICIES: dict[str, int] = {
    "base": mask("few_words", "repeated_windows"),
    "2024.1": mask("few_words", "repeated_windows", "symbol_heavy", "duplicate_lines"),
    "2025.1": mask(*RULES),
}
CURRENT = "2025.1"


def _count(text: Column, chars: str) -> Column:
    """How many characters of a text are of a class, given as what stands between the brackets of a pattern."""
    return F.regexp_count(text, F.lit(f"[{chars}]")).cast("long")


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with every measurement; no shuffle, no Python.

    Windows of eight words are hashed by doubling (pairs, fours, eights). A document whose window hashes are all
    distinct has no repeat; only others sort their windows to find the words that repeats cover.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).select("doc_id", text.alias("text"))
    t = F.col("text")
    listed = base.select(
        "doc_id",
        (F.length(t).cast("long") - _count(t, SPACE)).alias("word_chars"),
        _count(t, SYMBOLS).alias("n_symbols"),
        _count(t, CAPITALS).alias("n_capitals"),
        (F.length(t) - F.length(F.replace(t, F.lit("!"), F.lit("")))).cast("long").alias("n_exclaims"),
        F.filter(F.split(t, "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0).alias("_lines"),
        F.array_remove(F.split(t, f"[{SPACE}]+"), "").alias("_words"),
    )
    hashed = listed.select(
        "doc_id", "word_chars", "n_symbols", "n_capitals", "n_exclaims",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_words").cast("long").alias("n_words"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h1"),
    )
    after = F.slice("_h1", F.lit(2), F.greatest(F.size("_h1") - 1, F.lit(0)))
    same = F.filter(F.zip_with("_h1", after, lambda a, b: F.coalesce(a == b, F.lit(False))), lambda x: x)
    hashed = hashed.withColumn("n_stutters", F.size(same).cast("long"))
    for width, name, source in ((1, "_h2", "_h1"), (2, "_h4", "_h2"), (4, "_h8", "_h4")):
        left = F.greatest(F.size(source) - width, F.lit(0))
        joined = F.zip_with(F.slice(source, F.lit(1), left), F.slice(source, F.lit(width + 1), left), lambda a, b: F.xxhash64(a, b))
        hashed = hashed.withColumn(name, joined).drop(source)
    some = F.size(F.array_distinct("_h8")) < F.size("_h8")
    empty = "cast(array() as array<struct<h:bigint,i:int>>)"
    ordered = F.when(some, F.sort_array(F.transform("_h8", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(F.expr(empty))
    hashed = hashed.withColumn("_sorted", ordered).drop("_h8")
    hashed = hashed.withColumn("_starts", F.expr("""sort_array(transform(
        filter(_sorted, (p, k) -> (k > 0 AND element_at(_sorted, greatest(k, 1)).h = p.h)
                               OR (k + 1 < size(_sorted) AND element_at(_sorted, least(k + 2, size(_sorted))).h = p.h)),
        p -> p.i))""")).drop("_sorted")
    covered = F.expr(f"""aggregate(transform(_starts, (p, k) ->
        if(k + 1 < size(_starts), least({WINDOW}, element_at(_starts, least(k + 2, size(_starts))) - p), {WINDOW})),
        0L, (a, x) -> a + x)""")
    # a value that isn't deterministic keeps the optimizer from pushing filters of the ledger down through the
    # measurements, which would repeat their expressions many times over; it adds nothing
    fence = F.pmod(F.monotonically_increasing_id(), F.lit(1))
    return hashed.withColumn("n_repeat_words", covered + fence).drop("_starts")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements and ``failed``, the failure bits of all rules."""
    measured = measure(docs, id_col, text_col)
    bits = [F.when(F.expr(condition), F.lit(1 << bit)).otherwise(F.lit(0)) for bit, condition in RULES.values()]
    total = bits[0]
    for one in bits[1:]:
        total = total.bitwiseOR(one)
    return measured.withColumn("failed", total.cast("int"))


def passes(version: str = CURRENT) -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed").bitwiseAND(F.lit(POLICIES[version])) == 0


def ablations(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """For each rule of a policy: documents failing it, failing it alone, and kept if the rule were dropped.

    The ledger is first summed per distinct bitmask, of which there are at most 2 ** rules, then joined with the
    few rules by bit arithmetic.
    """
    policy = POLICIES[version]
    counts = book.groupBy(F.col("failed").bitwiseAND(F.lit(policy)).alias("bits")).agg(F.count("*").alias("n"))
    rows = [(name, 1 << bit) for name, (bit, _) in RULES.items() if policy >> bit & 1]
    aggregates = []
    for name, one in rows:
        hit = F.col("bits").bitwiseAND(F.lit(one)) != 0
        rest = F.col("bits").bitwiseAND(F.lit(policy & ~one)) == 0
        aggregates += [
            F.sum(F.when(hit, F.col("n")).otherwise(0)).alias(f"{name}__fails"),
            F.sum(F.when(hit & rest, F.col("n")).otherwise(0)).alias(f"{name}__alone"),
            F.sum(F.when(rest, F.col("n")).otherwise(0)).alias(f"{name}__kept_without"),
        ]
    wide = counts.agg(*aggregates)
    stack = ", ".join(f"'{name}', {name}__fails, {name}__alone, {name}__kept_without" for name, _ in rows)
    return wide.select(F.expr(f"stack({len(rows)}, {stack}) as (rule, fails, fails_alone, kept_without)")).select(
        F.lit(version).alias("policy"), "rule", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("fails", "fails_alone", "kept_without")])


def judged(book: DataFrame, version: str = CURRENT) -> DataFrame:
    """A ledger with ``base_failed`` and ``kept`` under a policy."""
    base = F.col("failed").bitwiseAND(F.lit(POLICIES["base"])) != 0
    return book.withColumn("base_failed", base).withColumn("kept", ~base & passes(version))


def keep(docs: DataFrame, version: str = CURRENT) -> DataFrame:
    """The documents that pass a policy, with all their columns.

    The verdict is computed beside the row it judges, so nothing is joined or shuffled.
    """
    carried = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc_id")
    packed = docs.select(carried, F.col("text").alias("text"))
    kept = ledger(packed).where(passes("base") & passes(version))
    return kept.select("doc_id.*")
