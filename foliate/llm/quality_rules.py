"""Quality rules as a short-circuit cascade ordered by rejection per cost.

``measure`` takes counts from a whole text, ``RULES`` judge them or the text. On a sample of rows each rule's
time a row and share of rejected rows are estimated; rules then run in the order of rejections
per time, and the first that rejects ends a row's cascade. The order changes the work only: a row
is kept if no rule rejects it.

The sample is about ``SAMPLE`` rows: those whose hash of id and text is below a threshold from the number of rows. Any layout of the
table gives the same rows, and each is measured in the task that reads it.

Defined results: a null or empty text has no words and fails the base rule; repeated rows get the
same verdict; ties in rejection per cost go by name; with an empty sample rules run by name;
a null id is passed on; other columns are ignored.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.common import as_text, id_and_text, table

SAMPLE = 500
MIN_WORDS = 50
#: Most repeated words in a hundred.
MAX_REPEATED = 50
#: Windows of so many words.
WINDOW = 3
SYMBOLS = "#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


class Counts(NamedTuple):
    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int


class Text:
    """A whole text with its bytes and words, which several rules share."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.data = text.encode("utf-8", "surrogatepass")
        self.words = self.data.split()


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words found twice or more in the text, the first included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    size = len(number)
    if size == len(words):
        return 0
    # Two steps keep the numbers small: pairs of words first, then pairs with the next word.
    pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)[1]
    _, window, counts = np.unique(pairs[: n] * size + ids[2:], return_inverse=True, return_counts=True)
    again = counts[window] > 1
    covered = np.zeros(len(words), bool)
    for i in range(WINDOW):
        covered[i : i + n] |= again
    return int(covered.sum())


def measure(x: Text) -> Counts:
    """The base counts of a whole text."""
    lines = [y for y in x.data.split(b"\n") if y.strip()]
    return Counts(
        len(x.words),
        len(x.text) - sum(x.data.count(bytes([c])) for c in SPACES),
        sum(x.data.count(c.encode()) for c in SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(x.words),
    )


def base_failed(c: Counts) -> bool:
    return c.n_words < MIN_WORDS or 100 * c.n_repeat_words > MAX_REPEATED * c.n_words


def _shouting(x: Text, c: Counts) -> bool:
    """More than half the letters of ASCII are capitals."""
    upper = sum(map(x.data.count, _UPPER))
    return upper > 30 and 2 * upper > upper + sum(map(x.data.count, _LOWER))


_UPPER = [bytes([c]) for c in range(ord("A"), ord("Z") + 1)]
_LOWER = [bytes([c]) for c in range(ord("a"), ord("z") + 1)]

#: Rules besides the base rule: True rejects.
RULES: dict[str, Callable[[Text, Counts], bool]] = {
    "word_length": lambda x, c: not 2 * c.n_words <= c.word_chars <= 25 * c.n_words,
    "symbols": lambda x, c: 10 * c.n_symbols > 3 * c.n_words,
    "duplicate_lines": lambda x, c: c.n_dup_lines > 0 and 10 * c.n_dup_lines > 7 * sum(1 for y in x.data.split(b"\n") if y.strip()),
    "shouting": _shouting,
    "exclamations": lambda x, c: 10 * x.data.count(b"!") > 3 * c.n_words,
    "few_words": lambda x, c: 20 * len(set(x.words)) < c.n_words,
    "letters": lambda x, c: 2 * sum(ch.isalpha() for ch in x.text) < c.word_chars,
}


def order_of(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE, rules: dict | None = None, id_col: str = "doc_id") -> tuple[list[str], dict]:
    """Rule names by rejections per time, and (share rejected, seconds a row) of each, from a sample of rows."""
    rules = RULES if rules is None else rules
    share = sample / max(docs.count(), 1)
    drawn = F.pmod(F.xxhash64(*[c for c in (id_col, text_col) if c in docs.columns]), F.lit(1 << 40)) < int(share * (1 << 40))
    rows = docs.where(drawn).select(as_text(F.col(text_col)).alias("text"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            texts = [Text(t) for t in batch.column(0).to_pylist()]
            counts = [measure(x) for x in texts]
            out = []
            for name, rule in rules.items():
                began = time.process_time_ns()
                rejected = sum(rule(x, c) for x, c in zip(texts, counts))
                out.append((name, len(texts), rejected, time.process_time_ns() - began))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["name", "n", "rejected", "ns"])

    got = rows.mapInArrow(run, "name string, n long, rejected long, ns long").groupBy("name").agg(F.sum("n").alias("n"), F.sum("rejected").alias("rejected"), F.sum("ns").alias("ns")).collect()
    stats = {r["name"]: (r["rejected"] / r["n"], r["ns"] / 1e9 / r["n"]) for r in got if r["n"]}
    rank = lambda k: (-stats[k][0] / max(stats[k][1], 1e-9) if k in stats else 0.0, k)
    return sorted(rules, key=rank), stats


def judge(docs: DataFrame, order: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, kept and rejected_by (the rule that ended the cascade, "base" or null) of every row."""
    order = order_of(docs, text_col, id_col=id_col)[0] if order is None else order
    source = id_and_text(docs, id_col, text_col)
    names = ["doc_id", *Counts._fields, "base_failed", "kept", "rejected_by"]
    types = [*[pa.int64()] * len(Counts._fields), pa.bool_(), pa.bool_(), pa.string()]

    def row(text: str) -> tuple:
        x = Text(text)
        counts = measure(x)
        failed = base_failed(counts)
        by = "base" if failed else next((name for name in order if RULES[name](x, counts)), None)
        return *counts, failed, by is None, by

    def run(batches):
        for batch in batches:
            columns = list(zip(*map(row, batch.column(1).to_pylist()))) or [[] for _ in types]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, kind in zip(columns, types))], names)

    id_type = source.schema["doc_id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in Counts._fields)
    return source.mapInArrow(run, f"doc_id {id_type}, {longs}, base_failed boolean, kept boolean, rejected_by string")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the five counts, base_failed and kept of every document."""
    return judge(table(spark, sf_dir, "documents")).drop("rejected_by")
