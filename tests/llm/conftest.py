import random

import pytest

#: Names that operators use inside; documents may have columns of these names too.
CLASHING = "row string, part string, node string, value string, label string, size string, path string, before string, score string, n string, owner string, draw string, place string, _source string, _whole string, _rest string, _last string, plan string, PLAN_ string, tie string, times string, key string, class_id string, local string, sha string, first_id string"


def words(rng, n):
    return " ".join("".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 7))) for _ in range(n))


def sample_rows():
    """Nulls, empties, ties, repeats, long texts, exact and near copies: (doc_id, text, lang, source)."""
    rng = random.Random(5)
    rows = []
    for k in range(60):
        rows.append((k, words(rng, rng.randint(1, 90)), rng.choice(["en", "de"]), rng.choice(["a", "b", "c", "c", "c", None])))
    base = words(rng, 80).split()
    for k in range(60, 100):  # near copies, some far
        copy = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 6])):
            copy[rng.randrange(len(copy))] = words(rng, 1)
        rows.append((k, " ".join(copy), "en", "c"))
    hot = "The  Same\tText again and again\nwith eight words"
    for k in range(100, 140):
        rows.append((k, rng.choice([hot, hot.upper(), hot.lower()]), "en", "c"))
    rows += [
        (140, None, "en", "a"), (141, "", None, "a"), (142, "  \n ", "en", None), (143, "?!", "en", "b"), (144, "one two", "en", "b"), (145, "one two", "en", "b"), (145, "one two", "en", "b"),
        (146, words(rng, 40_000), "de", "b"), (147, "x" * 50_000, "en", "a"), (None, "text without an id here now", "en", "a"), (None, None, None, None), (7, "another text of a repeated id", "en", "a"),
        (148, "Straße déjà vu ẖ H̱ İ Σας   \x1c don't 'test <|endoftext|> <|ENDOFTEXT|> 🙂 é", "fr", "b"), (-5, "a negative id", "en", "a"),
    ]
    return rows


@pytest.fixture(scope="session")
def rows():
    return sample_rows()


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    """The rows as a Parquet table of several files, with clashing columns."""
    path = str(tmp_path_factory.mktemp("docs") / "documents.parquet")
    extra = CLASHING.count(",") + 1
    frame = spark.createDataFrame([(*r, len(r[1] or ""), *["x"] * extra) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")
    frame.repartition(5).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
