import random


import pytest



COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, score double, tie long, block long, "
           "k0 string, fp string, train boolean, bucket int, kept string, host string")
LABELS = "doc_id long, quality int, toxic int"


def prose(seed, n, pool=400):
    rng = random.Random(seed)
    return " ".join(f"{rng.choice('abcdefgh')}w{rng.randrange(pool)}" for _ in range(n))


def odd_rows():
    """Nulls, empty and long texts, copies, near copies, repeated rows, shared passages."""
    base, passage = prose(1, 120), prose(2, 60)
    edited = base.split()
    edited[50] = "changed"
    far = base.split()
    far[40], far[80] = "other", "words"
    texts = [
        (1, base), (2, base), (3, " ".join(edited)), (4, " ".join(far)), (5, None), (6, ""), (7, " \n\t "), (8, "one two"),
        (9, "one  TWO"), (10, "x" * 350), (11, "ab" * 200), (12, prose(3, 80) + " " + passage), (13, prose(4, 70) + "\n" + passage + " end"),
        (14, passage), (15, prose(5, 3000)), (16, "naïve café ▁ 😀 " + prose(6, 30)), (17, "!!! 123 ..."),
        (18, "line a b c\nline a b c\n\nline a b c\n" + prose(7, 25)), (18, prose(8, 40)), (18, prose(8, 40)),
        (None, prose(9, 50)), (None, None), (20, " ".join(["the same eight words again and again here"] * 12)),
        (21, "<|endoftext|> tail  of   blanks   x   y ends "), (22, base.upper()),
    ]
    return [(d, t, ["en", "de", None][k % 3], "src0", None, 1.5, 7, 3, "k", "f", False, 1, "c", "h") for k, (d, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    rows = odd_rows()
    return spark.createDataFrame(rows, COLUMNS).repartition(3).cache()


@pytest.fixture(scope="session")
def odd_pairs():
    return [(r[0], r[1]) for r in odd_rows()]


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def same(got, want, places=None):
    def norm(rows):
        return sorted([tuple(round(v, places) if places is not None and isinstance(v, float) else v for v in r) for r in rows], key=repr)

    got, want = norm(map(tuple, got)), norm(want)
    assert len(got) == len(want)
    assert [(g, w) for g, w in zip(got, want) if g != w] == []
