"""Quality rules as a bitmask ledger.

``measure`` reads every text once and stores what was measured; ``ledger`` turns the measurements into one failure bit a rule;
policies are versioned masks over these bits, so another policy, or an ablation of one, never reads a text again. All of it is
DataFrame functions: no Python runs on the executors, and nothing is shuffled but counts of bit patterns in ``ablation``.

Edge cases: a null or empty text has no words, zero measurements and fails ``too_short``; repeated rows are measured each on its
own; an empty table gives an empty ledger; further columns of the input are ignored.

Three-word windows are compared by a 64-bit hash within one text, so a text of n words errs with a chance near n * n / 2**65.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import SEPARATORS, let, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 3


def _covered(positions: Column) -> Column:
    """How many words the windows that start at these sorted positions cover."""
    fresh = F.transform(positions, lambda p, k: F.least(F.lit(WINDOW), p - F.coalesce(F.get(positions, k - 1), p - WINDOW)))
    return F.aggregate(fresh, F.lit(0), lambda a, b: a + b)


def _repeated(grams: Column) -> Column:
    """Words in windows whose hash occurs twice or more. Sorting brings equal ones together: n log n for any text."""
    pairs = F.sort_array(F.transform(grams, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def positions(s: Column) -> Column:
        twice = F.filter(s, lambda x, k: F.coalesce(x.h == F.get(s, k - 1).h, F.lit(False)) | F.coalesce(x.h == F.get(s, k + 1).h, F.lit(False)))
        return F.sort_array(F.transform(twice, lambda x: x.i))

    return let(let(pairs, positions), _covered)


def n_repeat_words(words: Column) -> Column:
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WINDOW))))
    some = let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(_repeated(g)))
    return F.when(n < WINDOW, F.lit(0)).otherwise(some)


def _measures(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SEPARATORS}]"))
    symbols = F.length(text) - F.length(F.regexp_replace(text, f"[{SYMBOLS}]+", ""))
    words = let(
        words_of(text),
        lambda w: F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), n_repeat_words(w).alias("n_repeat_words")),
    )
    line = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    return let(
        F.struct(words.alias("w"), line.alias("l")),
        lambda m: F.struct(
            m.w.n_words.cast("long").alias("n_words"),
            m.w.word_chars.cast("long").alias("word_chars"),
            F.when(text.rlike(f"[{SYMBOLS}]"), symbols).otherwise(0).cast("long").alias("n_symbols"),
            m.l.n_dup_lines.cast("long").alias("n_dup_lines"),
            m.w.n_repeat_words.cast("long").alias("n_repeat_words"),
            m.l.n_lines.cast("long").alias("n_lines"),
        ),
    )


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and a struct m of measurements, each text read once."""
    return docs.select("doc_id", let(F.coalesce(F.col("text"), F.lit("")), _measures).alias("m"))


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails``, SQL over the measurements, is true. Its bit never changes."""

    bit: int
    name: str
    fails: str

    @property
    def mask(self) -> int:
        return 1 << self.bit


RULES = (
    Rule(0, "too_short", "n_words < 50"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > word_chars"),
    Rule(3, "repeated_lines", "n_dup_lines >= 3 AND 2 * n_dup_lines > n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 20 * n_words"),
)

#: Versioned policies: the rules that count.
POLICIES = {"v1": ("too_short", "repeated_words"), "v2": ("too_short", "repeated_words", "symbols", "repeated_lines", "word_length")}


def policy_mask(version: str, rules: tuple[Rule, ...] = RULES) -> int:
    return sum(r.mask for r in rules if r.name in POLICIES[version])


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the measurements, and failure_bits: bit k is set where rule k fails."""
    measured = measure(docs).select("doc_id", "m.*")
    bits = " + ".join(f"IF({r.fails}, {r.mask}L, 0L)" for r in rules)
    return measured.withColumn("failure_bits", F.expr(bits))


def apply_policy(of: DataFrame, version: str, column: str = "kept") -> DataFrame:
    """A boolean: none of the policy's rules failed."""
    return of.withColumn(column, F.col("failure_bits").bitwiseAND(policy_mask(version)) == 0)


def ablation(of: DataFrame, version: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: documents that fail it, that only it rejects, and that stay without it.

    Rows are first counted by bit pattern, of which there are at most 2 ** rules however long the ledger is.
    """
    mask = policy_mask(version, rules)
    counts = of.groupBy("failure_bits").agg(F.count("*").alias("n"))
    own = [F.struct(F.lit(r.name).alias("rule"), F.lit(r.mask).cast("long").alias("bit")) for r in rules if r.mask & mask]
    each = counts.select("failure_bits", "n", F.explode(F.array(*own)).alias("r")).select("failure_bits", "n", "r.*")
    n = lambda condition: F.sum(F.when(condition, F.col("n")).otherwise(0)).alias
    bits = F.col("failure_bits")
    return each.groupBy("rule").agg(
        n(bits.bitwiseAND(F.col("bit")) != 0)("failed"),
        n(bits.bitwiseAND(mask) == F.col("bit"))("failed_alone"),
        n(bits.bitwiseAND(F.lit(mask).bitwiseXOR(F.col("bit"))) == 0)("kept_without"),
    )


def quality_rules(docs: DataFrame, version: str = "v2") -> DataFrame:
    """The ledger with the verdicts of the base policy (``base_failed``) and of a version (``kept``)."""
    base = policy_mask("v1")
    of = ledger(docs).withColumn("base_failed", F.col("failure_bits").bitwiseAND(base) != 0)
    return apply_policy(of, version).withColumn("kept", F.col("kept") & ~F.col("base_failed"))
