"""Small tables with every awkward case, and DuckDB over the smallest test tables."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, taken string, row string, batch string, digest string, kept string, copies int, label int"
#: More columns, with names that operators use inside.
CLASH = ("x", "y", "z", "w", "v", "u", 5, 1)
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(rng, words):
    return " ".join(rng.choice(WORDS) for _ in range(words))


def edge_rows(seed=1, plain=30):
    rng = random.Random(seed)
    rows = [(i, prose(rng, rng.randrange(3, 80))) for i in range(plain)]
    rows += [
        (100, None), (101, ""), (102, " \t\n "), (103, "Word"), (104, "two words"), (None, rows[0][1]), (None, "no id at all"),
        (105, rows[1][1]), (106, rows[1][1].upper()), (2, rows[2][1]), (2, "another text under a used id"), (-7, rows[3][1] + " more"),
        (107, prose(rng, 30_000)), (108, "x" * 60_000), (109, "é😀 ñandú übergroß " * 40),
    ]
    return rows


def edge_docs(spark, rows=None):
    rows = edge_rows() if rows is None else rows
    full = [(i, t, "en" if k % 5 else None, None if k % 7 == 0 else f"s{k % 3}", 1) + CLASH for k, (i, t) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def key(row):
    return tuple((v is None, str(type(v)), str(v)) for v in row)


def by_key(rows):
    return sorted((tuple(r) for r in rows), key=key)
