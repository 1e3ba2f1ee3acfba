import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use for their own work.
CLASHES = "block id rest node size key kept seen codes mix_row mix_size sample_hash ngram_join_gone entries class_id cell".split()


def make_rows() -> list[tuple]:
    """Documents with copies, near copies, shared lines and passages, nulls, empty, very long and repeated texts."""
    rng = random.Random(5)
    syllables = "ka lo mi ten ra vu shi on er zu pol né".split()
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(9) for _ in range(3)]
    passage = line(40)
    rows: list[list] = []
    for i in range(60):
        lines = [line(rng.randint(3, 30)) for _ in range(rng.randint(1, 6))]
        if i % 4 == 0:
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(shared).upper() + " \t")
        if i % 7 == 0:
            lines.append(passage)
        rows.append([i, "\n".join(lines), "xy", f"s{i % 5}", 1])
    for i, of in enumerate((3, 3, 8, 21)):
        rows.append([60 + i, rows[of][1], None, "s1", None])
    for i, of in enumerate((10, 11, 12, 12)):
        words = rows[of][1].split(" ")
        words[len(words) // 2] = "changed"
        rows.append([70 + i, " ".join(words), "xy", None, 1])
    rows += [
        [80, None, None, None, None],
        [81, "", "xy", "s2", 0],
        [82, "", "xy", "s2", 0],
        [83, " \t\n\n", "xy", "s2", 4],
        [84, "one two", "xy", "é", 7],
        [85, "one two", "xy", "é", 7],
        [86, "x" * 30_000, "xy", "s3", 30_000],
        [87, ("na " * 12_000).strip(), "xy", "s3", 36_000],
        [88, "zero\x00byte and 漢字 ▁ <s> <|endoftext|> 😀 " + line(12), "xy", "s3", 1],
        [None, line(30), "xy", "s4", 1],
        [None, shared[0], "xy", "s4", 1],
        [5, rows[5][1], "xy", "s0", 1],
    ]
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, COLUMNS).withColumns({c: F.lit(1) for c in CLASHES}).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def first_rows(rows):
    """The rows with an id, one for each id."""
    return list({r[0]: r for r in rows if r[0] is not None}.values())
