"""Chains within blocks of numbers, across them, and how much is moved for them."""

import pytest

from roamgrid.operators import contract
from tests.test_search import frame, road


def shape(found):
    chains = {(r["first"], r["second"], tuple(r["nodes"]), tuple(r["there"]), tuple(r["back"])) for r in found.chains.collect()}
    return chains, {tuple(r) for r in found.rest.collect()}


def test_blocks_change_no_chain(spark, monkeypatch):
    """Whether all chains lie within a block, some or none; rings and long chains are cut at the same nodes."""
    edges = road(5)[0]
    keep = spark.createDataFrame([(12,), (13,)], "node long")
    for longest, stay in ((4096, None), (2, keep)):
        shapes = []
        for bits in (0, 2, 15):
            monkeypatch.setattr(contract, "BLOCK", bits, raising=False)
            shapes.append(shape(contract.contract(frame(spark, edges), stay, longest)))
        assert shapes[0] == shapes[1] == shapes[2]
        assert shapes[0][0]


def test_chains_within_a_block_are_not_ranked(spark):
    """A chain of near numbers takes no list ranking over the cluster."""
    edges = [(a, a + 1, 1) for a in range(40)] + [(a + 1, a, 1) for a in range(40)]
    with pytest.MonkeyPatch.context() as m:
        m.setattr(contract, "_ranked", lambda *a: pytest.fail("ranked"))
        (chain,) = contract.contract(frame(spark, edges)).chains.collect()
    assert chain["nodes"] in (list(range(1, 40)), list(range(39, 0, -1)))
