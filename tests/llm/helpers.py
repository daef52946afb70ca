"""Documents with every awkward case: nulls, empties, repeats, ties, long texts and clashing columns."""

from __future__ import annotations

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    return " ".join(f"{WORDS[(seed * 7 + i * i + 3 * i) % 20]}{(seed * 31 + i) % 97}" for i in range(n))


LONG = prose(5, 60_000)
ROWS = [
    (1, prose(1, 80), "s", "x"),
    (1, prose(1, 80), "s", "x"),
    (2, prose(1, 80), "s", "y"),
    (3, None, "s", "z"),
    (4, "", None, None),
    (5, " \n\t \n", "t", "z"),
    (6, LONG, "t", "z"),
    (None, prose(2, 60), "s", "z"),
    (None, None, None, None),
    (7, "one", "s", "z"),
    (8, "中文。" * 40 + " é \x01 \x02 <|endoftext|>  two  spaces\r\n", "s", "z"),
    (9, prose(9, 60) + "\n" + prose(9, 60), "u", "z"),
]
#: Names that the operators use inside; the tables of a user may have them too.
CLASHING = "fp root component_id row found spans host page line n_pages score value owner all count file ids n_tokens words family".split()


def awkward(spark):
    extra = ", ".join(f"{c} string" for c in CLASHING)
    return spark.createDataFrame([(i, t, "en", s, 0 if t is None else len(t), *[o] * len(CLASHING)) for i, t, s, o in ROWS], f"doc_id long, text string, lang string, source string, n_chars long, {extra}")


def nothing(spark):
    return awkward(spark).where("false")
