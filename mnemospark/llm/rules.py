"""Quality rules as a bitmask ledger.

Every rule is evaluated once for every text. The ledger keeps the measurements and one
bit per failed rule; a policy is a versioned mask over those bits, so applying another
policy, or finding what each rule alone removes, reads no text again.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemospark.llm.common import BLANKS, make_room, map_text, spare

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_same_next", "n_upper")

#: Rules by bit: name and the condition, over the measurements, under which a text fails.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 30 * n_words",
    "duplicate_lines": "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 100 * n_words)",
    "same_next": "n_words >= 10 and 100 * n_same_next > 30 * n_words",
    "upper_words": "n_words >= 10 and 100 * n_upper > 60 * n_words",
}
BIT = {name: 1 << i for i, name in enumerate(RULES)}


@dataclass(frozen=True)
class Policy:
    """A named, versioned choice of rules; a document is kept if it fails none of them."""

    name: str
    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(BIT[r] for r in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_windows"))
STRICT = Policy("prose", 1, tuple(RULES))


def measures(text: str | None) -> tuple[int, ...]:
    """MEASURES of one text; null counts as empty.

    n_repeat_words counts the words inside a window of five that occurs twice or more, the first included.
    """
    text = text or ""
    raw = text.encode()
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(text.count(c) for c in BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in text.split("\n") if line.strip(BLANKS)]
    again = 0
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    if len(set(windows)) < len(windows):
        count = Counter(windows)
        twice = np.fromiter((count[w] > 1 for w in windows), dtype=bool, count=len(windows))
        step = np.zeros(n + 1, dtype=np.int64)
        at = np.flatnonzero(twice)
        step[at] += 1
        np.subtract.at(step, at + WINDOW, 1)
        again = int((np.cumsum(step)[:n] > 0).sum())
    same_next = sum(map(bytes.__eq__, words, words[1:]))
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    return n, chars, symbols, len(lines) - len(set(lines)), again, len(lines), same_next, upper


def ledger(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """keep (by default all columns) plus MEASURES and `failed`, the bits of the failed rules.

    Null and empty texts have zero for every measure and so fail few_words. Columns of docs that are named
    like a new one are renamed by leading underscores, so keep must not name them. An empty table gives an empty one;
    repeated rows stay.
    """
    docs = make_room(docs, *MEASURES, "failed")
    keep = docs.columns if keep is None else keep

    def work(texts: list[str | None]) -> list[pa.Array]:
        rows = np.array([measures(t) for t in texts], dtype=np.int64).reshape(len(texts), len(MEASURES))
        return [pa.array(rows[:, i]) for i in range(len(MEASURES))]

    out = map_text(docs, text_col, work, [(m, pa.int64()) for m in MEASURES], ", ".join(f"{m} bigint" for m in MEASURES), keep)
    bits = [F.when(F.expr(rule), F.lit(BIT[name])).otherwise(F.lit(0)) for name, rule in RULES.items()]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return out.withColumn("failed", failed.cast("long"))


def passes(policy: Policy, failed: str = "failed") -> Column:
    """Whether a ledger row fails no rule of the policy."""
    return F.col(failed).bitwiseAND(F.lit(policy.mask)) == 0


def ablation(entries: DataFrame, policy: Policy) -> DataFrame:
    """For each rule of the policy: how many documents fail it, fail only it, and are kept without it.

    Rows are first counted by their failure bits, of which there are at most 2 ** len(RULES).
    """
    counts = entries.groupBy(F.col("failed").bitwiseAND(F.lit(policy.mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BIT[r]).cast("long").alias("bit")) for r in policy.rules])).alias("r")
    each = counts.select("bits", "n", rules)
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    alone = F.col("bits") == F.col("r.bit")
    without = F.col("bits").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(total(hit).alias("fails"), total(alone).alias("fails_only"), total(without).alias("kept_without"))


def kept(docs: DataFrame, policy: Policy, text_col: str = "text") -> DataFrame:
    """The documents that the policy keeps, with the columns of docs, whatever their names."""
    columns = docs.columns
    safe = {c: spare(docs, f"own_{i}") for i, c in enumerate(columns)}
    renamed = docs.select(*[F.col(f"`{c}`").alias(safe[c]) for c in columns])
    good = ledger(renamed, safe[text_col]).where(passes(policy))
    return good.select(*[F.col(safe[c]).alias(c) for c in columns])
