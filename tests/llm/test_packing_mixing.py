"""Containers and mixes: invariants, brute force on small inputs, odd inputs."""

import itertools
import random

import numpy as np
import pytest

from foldsearch.llm import mixing, packing, tokens


def test_token_counts(spark):
    texts = ["", None, "Hello world", "<|endoftext|>", "é" * 5000, "a b  c\n\n"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id int, text string, n_tokens int")
    got = {r["id"]: r["n_tokens"] for r in tokens.token_counts(df, ["id"], "text").collect()}
    enc = tokens.encoding(tokens.VOCABULARY)
    assert got == {i: len(enc.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    assert enc.decode(enc.encode_ordinary(texts[4])) == texts[4]
    assert tokens.token_counts(df.limit(0), ["id"], "text").count() == 0


def test_words_are_cut_as_the_pattern_says():
    import regex

    r, pattern = random.Random(3), regex.compile(tokens.PATTERN)
    pool = [*"ab  \n\t\'\'\'stredlmv 12é٣²—.!? \u3000\x1c\x85界\xa0", "'s", "'re", "'ll ", "  ", "\n\n", " '", "'ve", "'D"]
    texts = ["".join(r.choices(pool, k=r.randint(1, 14))) for _ in range(20_000)]
    points, starts = tokens.laid_out(texts)
    begin = tokens.words(points, starts)
    whole, cuts = "".join(texts), iter(zip(begin, [*begin[1:], len(points)]))
    assert [whole[a:b] for a, b in cuts] == [w for t in texts for w in pattern.findall(t)]
    counter, enc = tokens.Counter(), tokens.encoding(tokens.VOCABULARY)
    assert list(counter.count([*texts[:3000], None, ""])) == [len(enc.encode_ordinary(t)) for t in texts[:3000]] + [0, 0]


def test_buckets_are_optimal():
    r = random.Random(1)
    for _ in range(30):
        lengths = np.array(sorted(r.sample(range(1, 60), r.randint(1, 7))))
        counts = np.array([r.randint(1, 9) for _ in lengths])
        price = r.choice([0.5, 5.0, 40.0])

        def cost(bounds):
            return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts)) + price * len(bounds)

        best = min(cost((*pick, lengths[-1])) for k in range(len(lengths)) for pick in itertools.combinations(lengths[:-1], k))
        assert cost(tuple(packing.length_buckets(lengths, counts, price))) == pytest.approx(best)


def run_pack(spark, sizes, capacities):
    df = spark.createDataFrame([(i, n, "x") for i, n in enumerate(sizes)], "doc_id long, n_tokens long, pack_id string").drop("pack_id")
    return packing.pack(df, capacities).collect()


@pytest.mark.parametrize("seed", range(3))
def test_pack_invariants(spark, seed, monkeypatch):
    monkeypatch.setattr(packing, "CHUNK_ROWS", 50)
    r = random.Random(seed)
    sizes = [r.choice([0, 1, 5, r.randint(1, 30), r.randint(1, 300)]) for _ in range(500)] + [40] * 100
    caps = {1: 40, 2: 128, 7: 1}
    if seed:
        del caps[7]
    got = run_pack(spark, sizes, caps)
    for p, c in caps.items():
        own = [x for x in got if x["pack_id"] == p]
        load, pieces = {}, {}
        for x in own:
            load[x["container_no"]] = load.get(x["container_no"], 0) + x["n_tokens"]
            pieces.setdefault(x["doc_id"], []).append((x["first_token"], x["n_tokens"]))
        assert set(pieces) == set(range(len(sizes)))
        assert max(load.values()) <= c
        for doc, parts in pieces.items():
            parts.sort()
            assert [a for a, _ in parts] == [i * c for i in range(len(parts))] and sum(n for _, n in parts) == sizes[doc]
            assert len(parts) == max(1, -(-sizes[doc] // c))  # cut only beyond the capacity
        assert sorted(load) == list(range(len(load)))
        assert len(load) <= 1.12 * -(-sum(sizes) // c) + sizes.count(0) // c + 2 or c == 1


def test_pack_odd_inputs(spark):
    assert run_pack(spark, [], {1: 10}) == [] and run_pack(spark, [3], {}) == []
    with pytest.raises(ValueError):
        run_pack(spark, [3], {1: 0})
    assert len({x["container_no"] for x in run_pack(spark, [0] * 30, {1: 10})}) <= 3


def test_pack_fills_equal_halves():
    plan = packing.plan_containers(np.array([3, 5, 7]), np.array([10, 10, 10]), 10, 0.0)
    assert plan.containers == 15


def test_buckets_keep_their_meaning_as_data_grow():
    """A hundred times the texts of each length: the same buckets, far fewer than lengths."""
    lengths = np.arange(1, 5001)
    counts = np.random.default_rng(2).integers(1, 40, 5000)
    one, many = packing.plan_containers(lengths, counts, 8192), packing.plan_containers(lengths, counts * 100, 8192)
    assert list(one.bounds) == list(many.bounds) and len(one.bounds) < 2500
    least = -(-int((lengths * counts * 100).sum()) // 8192)
    assert many.containers < 1.003 * least


def test_many_lengths_stay_optimal():
    """Over 10,000 lengths: as cheap as the programme that tries every boundary."""
    lengths = np.cumsum(np.random.default_rng(3).integers(1, 4, 12_000))
    counts = np.random.default_rng(4).integers(1, 5, len(lengths))
    n, tokens, best = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(counts * lengths)]), np.zeros(len(lengths) + 1)
    for j in range(1, len(lengths) + 1):
        best[j] = (best[:j] + lengths[j - 1] * (n[j] - n[:j]) - (tokens[j] - tokens[:j])).min() + 8
    bounds = packing.length_buckets(lengths, counts, 8.0)
    padded = int(((bounds[np.searchsorted(bounds, lengths)] - lengths) * counts).sum())
    assert padded + 8 * len(bounds) == best[-1]


def test_schedule_counts():
    for n in (0, 1, 2, 3, 17, 64, 1000):
        pts = [mixing.van_der_corput(i) for i in range(n)]
        for x in (0, 1 << 38, (1 << 40) // 3, 1 << 40):
            assert mixing.points_below(n, x) == sum(p < x for p in pts)


def counts_of(spark, sizes):
    return spark.createDataFrame([(i, s, n) for i, (s, n) in enumerate(sizes)], "doc_id long, source string, n_tokens long")


def test_mix_reaches_shares(spark):
    r = random.Random(2)
    sizes = [("big", r.randint(0, 400)) for _ in range(900)] + [("mid", r.randint(1, 300)) for _ in range(200)] + [("small", r.randint(1, 200)) for _ in range(60)] + [(None, 50)] * 20 + [("unlisted", 9)] * 20
    targets = {"big": mixing.Target(0.5, 1), "mid": mixing.Target(0.3, 2), "small": mixing.Target(0.15, 4), "none": mixing.Target(0.05, 3)}
    mixed, plan = mixing.mix(counts_of(spark, sizes), targets, block=64)
    used = {x["doc_id"]: x["n_uses"] for x in mixing.uses(mixed).collect()}
    total, by = 0, {}
    for i, k in used.items():
        s, n = sizes[i]
        assert k <= targets[s].max_repeats
        by[s] = by.get(s, 0) + k * n
        total += k * n
    for s in ("big", "mid", "small"):
        assert abs(by[s] / total - targets[s].share / 0.95) < 0.02
    have = {s: sum(n for x, n in sizes if x == s) for s in by}
    assert any(by[s] > 0.93 * have[s] * targets[s].max_repeats for s in by)  # as long as the scarcest source allows
    # any prefix is mixed
    first = [x for x in mixed.collect() if x["slot_no"] < plan.slots // 4]
    part = sum(x["n_tokens"] for x in first if x["source"] == "big") / sum(x["n_tokens"] for x in first)
    assert abs(part - 0.5 / 0.95) < 0.06
    listed = spark.createDataFrame([(s, t.share, t.max_repeats) for s, t in targets.items()], "source string, target_share double, max_repeats int")
    got = {x["source"]: x for x in mixing.shares(mixed, listed).collect()}
    assert set(got) == set(targets) and got["none"]["n_tokens"] == 0 and sum(x["actual_share"] for x in got.values()) == pytest.approx(1)


def test_mix_is_repeatable_and_spread(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 1)
    sizes = [("a", 10 + i % 7) for i in range(300)] + [("b", 20)] * 50
    targets = {"a": mixing.Target(0.5, 3), "b": mixing.Target(0.5, 3)}
    one = sorted(tuple(x) for x in mixing.mix(counts_of(spark, sizes), targets, block=64)[0].collect())
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 100_000)
    assert one == sorted(tuple(x) for x in mixing.mix(counts_of(spark, sizes), targets, block=64)[0].collect())


@pytest.mark.parametrize("targets", [{}, {"x": mixing.Target(1.0, 1)}, {"a": mixing.Target(0.0, 1)}, {"a": mixing.Target(1.0, 0)}])
def test_mix_of_nothing(spark, targets):
    mixed, _ = mixing.mix(counts_of(spark, [("a", 5), (None, 5), ("a", 0)]), targets)
    assert mixed.count() == 0
    assert mixing.mix(counts_of(spark, []), {"a": mixing.Target(1.0, 1)})[0].count() == 0


def test_mix_of_one_long_text(spark):
    mixed, _ = mixing.mix(counts_of(spark, [("a", 1_000_000), ("b", 5)]), {"a": mixing.Target(0.9, 1), "b": mixing.Target(0.1, 1)})
    assert all(x["n_uses"] <= 1 for x in mixing.uses(mixed).collect())
