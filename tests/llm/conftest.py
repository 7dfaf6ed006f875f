import random

import pytest

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    """documents of (doc_id, text[, lang[, source]])."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DDL).repartition(3)


def prose(rng, n, words="alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega ñu éa größe".split()):
    out = []
    for k in range(n):
        out.append(rng.choice(words) + str(rng.randrange(40)))
        out.append("\n" if k % 17 == 16 else " ")
    return "".join(out).strip()


@pytest.fixture(scope="session")
def rough():
    """Documents with everything that an operator must stand: nulls, blanks, long texts, copies, near copies, shared lines, repeated rows."""
    rng = random.Random(7)
    base = [prose(rng, n) for n in (30, 60, 120, 250, 40, 80)]
    shared = prose(rng, 70).replace("\n", " ")
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(10, base[2]), (11, base[2]), (12, base[3].replace("alpha", "ALPHA", 1) + " end"), (13, base[3] + "\n" + shared), (14, shared + "\n" + base[1]), (15, f"before {shared} after"), (16, "  " + base[0].split("\n")[0].upper() + "\t\n\nshort\nshort")]
    rows += [(20, None), (21, ""), (22, " \t\n"), (23, "one"), (24, "one two"), (25, "ONE TWO"), (26, "x" * 5000), (27, "ab " * 3000), (28, prose(rng, 6000)), (29, "\n" * 300), (30, "é" * 300), (31, "\x00\x1f\x7f   \U0001f600 \xa0")]
    rows += [(5, base[5]), (5, base[5]), (32, base[4] + " tail"), (32, "another text under the same id"), (None, base[1]), (None, None), (None, "no id but words enough to make some shingles here")]
    return rows
