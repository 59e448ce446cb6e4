import random

import pytest

# Names that the operators use inside, as columns of the input.
CLASHING = "row id key token words n hash name bucket first kind start found lines node component role place level sequence_id".split()


def messy(spark, rows, schema):
    """A table with extra columns whose names clash, in several partitions."""
    first = [f.split()[0] for f in schema.split(", ")]
    extra = [c for c in CLASHING if c not in first]
    full = [(*r, *([-7] * len(extra))) for r in rows]
    return spark.createDataFrame(full, f"{schema}, " + ", ".join(f"`{c}` int" for c in extra)).repartition(3)


@pytest.fixture(scope="session")
def texts():
    """(id, text, lang, source): NULL, empty, blank, very long, repeated, near and exact copies, odd characters."""
    draw = random.Random(11)
    words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 9))) for _ in range(400)]

    def prose(n):
        return " ".join(draw.choice(words) for _ in range(n))

    passage = prose(60)
    rows = []
    for i in range(40):
        rows.append((i, "\n".join(prose(draw.randint(3, 60)) for _ in range(draw.randint(1, 5))), "en", f"s{i % 4}"))
    copy = rows[5][1]
    rows += [(40, copy, "en", "s0"), (41, copy, "de", "s1"), (42, copy + " end", "en", "s2"), (43, copy.replace(" ", "  ", 3), "en", "s0")]
    rows += [(50 + i, f"{prose(9)}\n{passage}\n{prose(12)}", "fr", None) for i in range(6)]
    rows += [(70, None, None, None), (71, None, "en", "s1"), (72, "", "en", "s1"), (73, " \t\n\n ", "en", "s0"), (74, "a", None, "s0")]
    rows += [(75, "same " * 300, "en", "s0"), (76, prose(6000), "en", "s3"), (77, "x" * 30_000, "en", "s3")]
    rows += [(78, "Été ß İ ＡＢ é '<|endoftext|>' 😀 \x1c   end", "fr", "s1"), (79, "|".join(prose(40).split()), "es", "s0")]
    rows += [rows[3], rows[3], (None, "no id here " + prose(70), "en", "s0"), (None, None, None, None)]
    return rows
