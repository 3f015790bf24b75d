"""No near line is left out: edits in every unit, windows that many lines have, random edits up to the bound."""

import random

from test_linededup import check


def test_no_link_is_left_out(spark):
    rng = random.Random(11)
    # A word in five replaced: four words in a row stay, nowhere more.
    line = [f"e{i}" for i in range(60)]
    spaced = [w if i % 5 < 4 else f"x{i}" for i, w in enumerate(line)]
    docs = [(1, " ".join(line)), (2, " ".join(spaced))]
    # Two lines share a window that many others have, and nothing else.
    many = "of the and to".split()
    for d in range(3, 63):
        docs.append((d, " ".join([*many, *[f"h{d}x{rng.randrange(10**6)}" for _ in range(16)]])))
    docs += [(d, " ".join(w for i in range(4) for w in [*many, f"t{d}x{i}"])) for d in (63, 64)]
    words = [f"w{i}" for i in range(400)]
    bases = [rng.choices(words, k=rng.randint(8, 50)) for _ in range(60)]
    for d in range(65, 245):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, len(w) // 5)):
            i = rng.randrange(len(w) + 1)
            w[i : i + rng.randint(0, 1)] = rng.choices(words, k=rng.randint(0, 1))
        docs.append((d, " ".join(w)))
    rows = {r.doc_id: r.dropped for r in check(spark, docs)}
    assert rows[2] == rows[64] == [0] and rows[1] == rows[63] == []
