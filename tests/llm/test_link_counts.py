"""Numbers of links of the n-gram join against brute force."""

import pytest

from quarry.llm import jaccard
from quarry.llm.common import table
from tests.llm.test_joins import frame, linked, near_copies, shingles


def brute_counts(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    return {i: sum(i != j and linked(s, o) for j, o in sets) for i, s in sets}


@pytest.mark.parametrize("block", [1_000_000, 300, 40])
def test_link_counts_match_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr("quarry.llm.setjoin.BLOCK_TOKENS", block)
    rows = near_copies(5, docs=12, copies=25)
    want = brute_counts(rows)
    assert max(want.values()) > 2
    assert {r.doc_id: r.n_links for r in jaccard.link_components(frame(spark, rows).repartition(3)).collect()} == want


def test_all_three_links_of_three_variants(spark):
    base = [f"w{k}" for k in range(100)]
    rows = [(k, " ".join(base[: 99 - k] + [f"x{k}"])) for k in range(3)] + [(3, " ".join([*base[:99], "x0"])), (4, None)]
    rows += [(None, rows[0][1])]
    got = {r.doc_id: r.n_links for r in jaccard.link_components(frame(spark, rows)).collect()}
    assert got == {0: 3, 1: 3, 2: 3, 3: 3, 4: 0, None: None}


def test_link_counts_of_the_table(spark):
    sf = "/root/testdata/sf0.001"
    want = brute_counts([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()])
    assert {r.doc_id: r.n_links for r in jaccard.op5_link_counts(spark, sf).collect()} == want
    assert jaccard.op5_ngram_jaccard(spark, sf).columns == ["doc_id", "n_shingles", "component_id", "n_links"]
