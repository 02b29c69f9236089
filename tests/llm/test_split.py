import random

import pytest

from sessionlake.llm.split import LINE, PARAGRAPH, SENTENCE, atoms, piece_bounds, split_oversized

SCHEMA = "id string, text string, most long, shared long, piece_no string, _text string"


@pytest.mark.parametrize("seed", range(5))
def test_pieces_cover_share_and_fit(seed):
    rng = random.Random(seed)
    for _ in range(400):
        text = "".join(rng.choice(["a", "b ", ".\n", ". ", ", ", "é", "👍🏽", "日", "。", "\r\n", "\n\n", "x" * 20]) for _ in range(rng.randint(0, 120)))
        limit, overlap = rng.randint(1, 80), rng.randint(0, 90)
        bounds, shared = piece_bounds(text, limit, overlap), min(overlap, limit - 1)
        assert bounds[0][0] == 0 and bounds[-1][1] == len(text)
        assert all(b - a <= limit for a, b in bounds)
        assert (len(bounds) > 1) == (len(text) > limit)
        if len(text) > limit:
            assert all(n[0] + shared == p[1] for p, n in zip(bounds, bounds[1:]))


def test_cuts_at_the_strongest_boundaries():
    text = "One two three. Four five six.\n\nSeven eight nine. Ten eleven."
    bounds = piece_bounds(text, 35, 0)
    assert [text[a:b] for a, b in bounds] == ["One two three. Four five six.\n\n", "Seven eight nine. Ten eleven."]


def test_line_breaks_outrank_the_mark_before_them():
    ranks = {"One two.\n\nThree": PARAGRAPH, "One two.\nThree": LINE, "One two. Three": SENTENCE, "One \n\nThree": PARAGRAPH, "One,\nThree": LINE, "One,  \r\n \r\n Three": PARAGRAPH, "一。\n\n二": PARAGRAPH, "一。二": SENTENCE}
    for text, rank in ranks.items():
        assert rank in atoms(text, 100)[1][:-1], text
        assert max(atoms(text, 100)[1][:-1]) == rank, text


def test_cuts_at_a_paragraph_though_a_line_fits_better():
    text = "First line of one.\nSecond line of one.\n\nFirst line of two.\nSecond line of two.\nThird line."
    assert text[slice(*piece_bounds(text, 70, 0)[0])].endswith("one.\n\n")


def test_the_indentation_stays_with_its_line():
    assert atoms("a:\n    b", 100)[0] == [3, 8]


def test_no_cut_inside_a_cluster():
    ends, _ = atoms("👍🏽" * 10, 5)
    assert all(e % 2 == 0 for e in ends)


def test_agrees_with_brute_force_merging():
    rng = random.Random(9)
    for _ in range(60):
        text = "".join(rng.choice(["ab", " ", ". ", "\n", ", "]) for _ in range(40))
        limit = rng.randint(5, 30)
        ends, strengths = atoms(text, limit)
        pieces = [[s, e, k] for s, e, k in zip([0, *ends[:-1]], ends, strengths)]
        while True:  # the weakest boundary of a pair that fits, smaller then earlier first
            fits = [(pieces[i][2], pieces[i + 1][1] - pieces[i][0], i) for i in range(len(pieces) - 1) if pieces[i + 1][1] - pieces[i][0] <= limit]
            if not fits or len(text) <= limit:
                break
            i = min(fits)[2]
            pieces[i : i + 2] = [[pieces[i][0], pieces[i + 1][1], pieces[i + 1][2]]]
        assert piece_bounds(text, limit, 0) == ([(a, b) for a, b, _ in pieces] if len(text) > limit else [(0, len(text))])


def test_odd_rows(spark):
    rows = [
        ("null", None, 5, 1, "x", "y"),
        ("empty", "", 5, 1, "x", "y"),
        ("no limit", "abcdefgh", None, 1, None, None),
        ("zero limit", "abcdefgh", 0, 1, None, None),
        ("no overlap", "aaa bbb ccc", 5, None, None, None),
        ("negative", "aaa bbb ccc", 5, -3, None, None),
        ("twice", "aaa bbb", 5, 0, None, None),
        ("twice", "aaa bbb", 5, 0, None, None),
        (None, "aaa bbb", 5, 0, None, None),
        ("long", "word " * 40_000, 1000, 100, None, None),
    ]
    got = split_oversized(spark.createDataFrame(rows, SCHEMA), "id", "text", "most", "shared").collect()
    by = {}
    for r in got:
        by.setdefault(r["id"], []).append(r)
    assert "null" not in by and [r["piece_text"] for r in by["empty"]] == [""]
    assert len(by["no limit"]) == len(by["zero limit"]) == 1
    assert len(by["no overlap"]) == len(by["negative"]) > 1
    assert len(by["twice"]) == 4 and len(by[None]) == 2
    assert all(len(r["piece_text"]) <= 1000 for r in by["long"]) and len(by["long"]) >= 200
    assert split_oversized(spark.createDataFrame([], SCHEMA), "id", "text", "most", "shared").count() == 0
