import random

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st

from cadenza.functions.fuzzy import common_lengths, common_matrix, ratio_of
from cadenza.operators.fuzzy_match import best_matches


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b):
            keep = row[j + 1]
            row[j + 1] = diagonal + 1 if x == y else max(row[j + 1], row[j])
            diagonal = keep
    return row[-1]


def ratio(a, b):
    size = len(a) + len(b)
    return round(100 * (2.0 * lcs(a, b) / size)) if size else 0


def test_known_ratios():
    pairs = [("these days", "these daze"), ("kitten", "sitting"), ("", ""), ("", "a"), ("abc", "abc")]
    left, right = pd.Series([p[0] for p in pairs]), pd.Series([p[1] for p in pairs])
    assert common_lengths(left, right)[0].tolist() == [8, 4, 0, 0, 3]
    assert ratio_of(left, right).tolist() == [80, 62, 0, 0, 100]
    assert ratio_of(pd.Series(["abcdefgh"]), pd.Series(["a" + "z" * 7])).tolist() == [12]  # 12.5 to even


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.text("abc 1", max_size=150), st.text("abc 1", max_size=150)), min_size=1, max_size=8))
def test_common_length_of_whole_texts(pairs):
    left, right = pd.Series([p[0] for p in pairs]), pd.Series([p[1] for p in pairs])
    assert common_lengths(left, right)[0].tolist() == [lcs(a, b) for a, b in pairs]
    assert ratio_of(left, right).tolist() == ratio_of(right, left).tolist()


@settings(max_examples=40, deadline=None)
@given(
    st.lists(st.text("ab 1", max_size=80), min_size=1, max_size=12),
    st.lists(st.text("ab 1", max_size=150), min_size=1, max_size=5),
)
def test_common_length_of_all_pairs(left, right):
    left = sorted([*left, *(text + "a" for text in left)])
    found = common_matrix(np.array(left, dtype=object), np.array(right, dtype=object))
    assert found.tolist() == [[lcs(a, b) for b in right] for a in left]


def test_requests_are_searched_in_chunks_not_as_rows_of_pairs(spark):
    asked = [(i, f"household by customer{i:09d}") for i in range(300)]
    titles = [(i, f"{a} {b} by brand{i % 7}") for i, (a, b) in enumerate((x, y) for x in "pqrst" for y in "uvwxyz")]
    found = best_matches(
        spark.createDataFrame(asked, "request_id long, search_text string"),
        spark.createDataFrame(titles, "track_id long, search_text string"),
        rows_per_cell=4,
        rows_per_block=9,
    )
    plan = found._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "fuzzy_ratio" not in plan
    best = {i: min((-ratio(a, t), j) for j, t in titles) for i, a in asked}
    assert {r.request_id: (-r.match_score, r.track_id) for r in found.collect()} == best


def test_best_match_is_exact_over_all_titles(spark):
    rng = random.Random(5)
    words = ["love", "night", "blue", "rain", "fire", "Heart", "a", "the", "go!", "9", "zq"]

    def phrase():
        return " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))

    titles = [phrase() for _ in range(150)] + ["", "!!", "x" * 130, "x" * 131 + "y"]
    requests = [phrase().replace("o", "", 1) for _ in range(40)]
    requests += ["", "??", "x" * 131, "wwwww", titles[3].upper() + "!"] + titles[:5]
    clean = lambda s: "".join(c for c in s.lower() if c in "abcdefghijklmnopqrstuvwxyz0123456789 ")
    expected = {}
    for r, asked in enumerate(requests):
        scores = [(-ratio(clean(asked), clean(t)) if clean(asked) and clean(t) else 0, i) for i, t in enumerate(titles)]
        best = min(scores)
        expected[r] = (best[1], -best[0])
    found = best_matches(
        spark.createDataFrame(list(enumerate(requests)), "request_id long, search_text string"),
        spark.createDataFrame(list(enumerate(titles)), "track_id long, search_text string"),
        rows_per_cell=6,
        rows_per_block=10,
    ).collect()
    assert {r.request_id: (r.track_id, r.match_score) for r in found} == expected
    assert all(r.is_weak_match == (r.match_score < 40) for r in found)
