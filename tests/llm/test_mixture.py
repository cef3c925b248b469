from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from corvane.llm.mixture import Shards, SourcePlan, Tokenizer, cut_blocks, mix_sources, permuted, plan_slots, slot_table, tokenised
from corvane.llm.queries import TOKENIZER

pytestmark = pytest.mark.skipif(not Path(TOKENIZER).exists(), reason="no vocabulary file")


def test_permutations():
    for n in (1, 2, 3, 10, 1000, 1025):
        for key in (0, 1, 2**63 + 5):
            p = permuted(np.arange(n), np.full(n, n), np.full(n, key, np.uint64))
            assert sorted(p.tolist()) == list(range(n))
    a, b = (permuted(np.arange(1000), np.full(1000, 1000), np.full(1000, k)) for k in (1, 2))
    assert (a != b).mean() > 0.9 and (a != np.arange(1000)).mean() > 0.9


def test_drawn_shards_add_up():
    shards = Shards([100, 0, 7, 893], 64, seed=3)
    drawn = [shards[i] for i in range(shards.n)]
    assert np.sum([here for _, here in drawn], axis=0).tolist() == [100, 0, 7, 893]
    assert [sum(here) for _, here in drawn[:-1]] == [64] * (shards.n - 1) and len({here for _, here in drawn}) > 3
    before = np.cumsum([(0, 0, 0, 0), *(here for _, here in drawn)], axis=0)
    assert [b for b, _ in drawn] == [tuple(x) for x in before[:-1].tolist()]


def test_draws_are_multinomial():
    slots, size = (3000, 1000), 50
    counts = np.array([Shards(slots, size, seed)[k][1] for seed in range(60) for k in range(80)])[:, 0]
    p = 0.75
    expected = size * p * (1 - p) * (1 - size / 4000)  # the variance of draws whose totals are given
    assert counts.mean() == pytest.approx(size * p, abs=0.3) and counts.var() == pytest.approx(expected, rel=0.12)


def test_a_hundred_billion_slots():
    slots = (60_000_000_000, 39_999_000_000, 999_900, 100)
    shards = Shards(slots, 8192, seed=5)
    assert shards.n == -(-sum(slots) // 8192) and shards[0][0] == (0, 0, 0, 0)
    for k in (0, 1, 77, shards.n // 2 - 1, shards.n // 3, shards.n - 2):
        before, here = shards[k]
        after = tuple(b + h for b, h in zip(before, here, strict=True))
        assert sum(before) == k * 8192 and sum(here) == 8192 and min(before) >= 0 and min(here) >= 0
        assert shards[k + 1][0] == after and all(a <= s for a, s in zip(after, slots, strict=True))
        assert here[0] / 8192 == pytest.approx(0.6, abs=0.04)
    before, here = shards[shards.n - 1]
    assert tuple(b + h for b, h in zip(before, here, strict=True)) == slots
    half = shards[shards.n // 2][0]
    assert half[0] / slots[0] == pytest.approx(0.5, abs=1e-4) and half[2] / slots[2] == pytest.approx(0.5, abs=0.01)


def test_slots_beyond_the_rows_of_a_driver(spark):
    plans = [SourcePlan("a", 0.5, 1, 10**11, 10**14, 10**11), SourcePlan("b", 0.5, 4, 10**6, 10**9, 4 * 10**6)]
    table = slot_table(spark, plans, 8192, 1)
    assert table.rdd.getNumPartitions() > 10_000  # and no row of it has been made


def blocks_of(spark, df, tasks, size=64):
    ranks = Path(TOKENIZER).read_bytes()
    tokens = tokenised(df.repartition(tasks), doc_id="doc_id", text="text", source="source", ranks=ranks).filter("n > 0")
    rows = cut_blocks(tokens, 1 << 25, size).collect()
    return sorted((r["source"], r["block"], r["n_tokens"], bytes(r["tokens"]), tuple(map(tuple, r["segments"]))) for r in rows)


def test_blocks_do_not_depend_on_the_number_of_tasks(spark):
    df = spark.createDataFrame(docs() + docs()[:30], "doc_id long, text string, source string")
    one, many = blocks_of(spark, df, 1), blocks_of(spark, df, 64)
    assert one == many
    for source in {b[0] for b in one}:
        mine = [b for b in one if b[0] == source]
        assert [b[1] for b in mine] == list(range(len(mine)))
        assert all(b[2] == 64 for b in mine[:-1])


def plan(*rows, total=None):
    plans = [SourcePlan(str(i), share, repeats, blocks, blocks * 10) for i, (share, repeats, blocks) in enumerate(rows)]
    plan_slots(plans, total)
    return [p.slots for p in plans]


def test_plans():
    assert plan((0.5, 1, 100), (0.5, 1, 100)) == [100, 100]
    assert plan((0.5, 1, 100), (0.5, 3, 10)) == [30, 30]
    assert plan((0.4, 1, 100), (0.4, 3, 10), (0.2, 1, 0)) == [30, 30, 0]
    assert plan((0.5, 1, 100), (0.5, 3, 10), total=1000) == [70, 30]
    assert plan((0.5, 1, 100), (0.5, 3, 10), total=10**9) == [100, 30]
    assert plan((0.0, 1, 5), (1.0, 0, 5)) == [0, 0] and plan() == []


def test_tiny_sources_are_limited_instead_of_setting_the_size():
    def shares(*rows, total=None):
        plans = [SourcePlan(str(i), share, repeats, blocks, tokens) for i, (share, repeats, blocks, tokens) in enumerate(rows)]
        plan_slots(plans, total)
        used = [p.slots * p.n_tokens / p.n_blocks for p in plans]
        return [p.slots for p in plans], [u / sum(used) for u in used]

    big = 1024 * 10_000
    slots, got = shares((0.6, 1, 10_000, big), (0.3, 1, 10_000, big), (0.1, 1, 1, 1))
    assert slots == [10_000, 5_000, 1] and got == pytest.approx([2 / 3, 1 / 3, 0], abs=1e-4)
    slots, _ = shares((0.6, 1, 10_000, big), (0.3, 1, 10_000, big), (0.1, 5, 1, 1), (0.0, 1, 5, 50))
    assert slots == [10_000, 5_000, 5, 0]
    # A source with enough blocks still sets the size, so that all shares are met; a second tiny one does not.
    slots, got = shares((0.6, 1, 10_000, big), (0.3, 1, 10_000, big), (0.1, 1, 100, 102_400), (0.001, 1, 1, 3))
    assert slots[:3] == [600, 300, 100] and got[:3] == pytest.approx([0.6, 0.3, 0.1], abs=0.002)


def test_one_word_source(spark):
    rows = [(i, "the old reader keeps every idle buffer " * 50, ["a", "b"][i % 2]) for i in range(400)] + [(1000, "word", "c")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    t = spark.createDataFrame([("a", 0.6, 1), ("b", 0.3, 1), ("c", 0.1, 1)], "source string, target_share double, max_repeats int")
    report = {r["source"]: r for r in mix_sources(d, t, tokenizer=TOKENIZER).report.collect()}
    assert report["a"]["actual_share"] == pytest.approx(2 / 3, abs=0.03) and report["b"]["actual_share"] == pytest.approx(1 / 3, abs=0.03)
    assert report["c"]["used_tokens"] == report["c"]["max_tokens"] > 0 and report["c"]["limited"]
    assert report["a"]["used_tokens"] > 0.95 * report["a"]["max_tokens"]


def docs():
    rows = [(i, f"commit {i}: change the file number {i * 7} again and again\n" * (i % 9 + 1), ["big", "big", "small"][i % 3]) for i in range(240)]
    rows += [(1000, "x " * 60_000, "one"), (1001, None, "big"), (1002, "", "big"), (1003, "text", None), (1004, "stray <|endoftext|>", "untargeted")]
    return rows + [(1005, "lone \ud800".encode("utf-8", "replace").decode(), "small")]


TARGETS = [("big", 0.5, 1), ("small", 0.3, 4), ("one", 0.2, 2), ("missing", 0.1, 3), (None, 0.5, 1), ("untargeted", None, 2), ("small", 0.1, 9)]


@pytest.fixture(scope="module")
def mixed(spark):
    d = spark.createDataFrame([(*r, 1, "clash") for r in docs()], "doc_id long, text string, source string, part int, block string")
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    return mix_sources(d, t, tokenizer=TOKENIZER, block_tokens=64, shard_slots=50)


def test_no_part_of_a_text_is_lost_or_repeated_too_often(mixed):
    rows = mixed.blocks.collect()
    tokenizer = Tokenizer(Path(TOKENIZER).read_bytes())
    whole = {i: tokenizer.encode(t) for i, t, _ in docs() if t}
    source = {i: s for i, _, s in docs()}
    allowed = {"big": 1, "small": 4, "one": 2}
    times = Counter()
    for r in rows:
        tokens = np.frombuffer(r["tokens"], "<u2")
        assert len(tokens) == r["n_tokens"] == sum(s["n"] for s in r["segments"]) <= 64
        at = 0
        for s in r["segments"]:
            assert source[s["doc_id"]] == r["source"]
            assert (tokens[at : at + s["n"]] == whole[s["doc_id"]][s["start"] : s["start"] + s["n"]]).all()
            at += s["n"]
            times[s["doc_id"], s["start"]] += 1
    assert all(n <= allowed[source[d]] for (d, _), n in times.items())
    assert len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
        assert len({r["source"] for r in rows if r["shard"] == shard}) > 1


def test_shares(mixed):
    report = {r["source"]: r for r in mixed.report.collect()}
    used = Counter()
    for r in mixed.blocks.select("source", "n_tokens").collect():
        used[r["source"]] += r["n_tokens"]
    assert {s: r["used_tokens"] for s, r in report.items() if r["used_tokens"]} == dict(used)
    assert set(report) == {"big", "small", "one", "missing", "untargeted"}
    for s, share in (("big", 0.5), ("small", 0.3), ("one", 0.2)):
        assert report[s]["actual_share"] == pytest.approx(share, abs=0.03)
    assert any(r["limited"] for s, r in report.items() if s in ("big", "small", "one"))
    assert report["missing"]["actual_share"] == 0 and report["untargeted"]["target_share"] == 0


def test_same_seed_same_mixture(spark, mixed):
    key = lambda m: sorted(map(tuple, m.blocks.select("shard", "slot", "source", "block").collect()))
    assert key(mixed) == key(mixed)


def test_empty_tables(spark):
    d = spark.createDataFrame(docs()[:9], "doc_id long, text string, source string")
    t = spark.createDataFrame(TARGETS, "source string, target_share double, max_repeats int")
    for m in (mix_sources(d.limit(0), t, tokenizer=TOKENIZER), mix_sources(d, t.limit(0), tokenizer=TOKENIZER)):
        assert m.blocks.count() == 0
        assert all(r["used_tokens"] == 0 and r["actual_share"] == 0 for r in m.report.collect())


def test_very_long_texts_are_encoded_in_pieces():
    tokenizer = Tokenizer(Path(TOKENIZER).read_bytes())
    text = "word " * 500_000
    assert tokenizer.encoding.decode(tokenizer.encode(text).tolist()) == text
