"""Splitting, co-occurrence, packing, mixing: against brute force, round trips and edge cases."""

import itertools
import math
import random
from collections import Counter
from fractions import Fraction

import pytest

from threadloom.llm import chunking, cooccur, mixing, packing, tokens

TEXT = "\n".join(f"user{k} (member):This is sentence {k}. And another one, about file{k}.py! " + "word " * (k % 30) for k in range(200))


def limits(spark):
    return spark.createDataFrame([("curated", 500, 40, "x"), ("chunk", 100, 10, "x")], "item_kind string, max_chars int, overlap_chars int, text string")


@pytest.mark.parametrize("text", [TEXT, "x" * 3000, "a\r\n" * 900, "é" * 1200, "。".join("文字" * 20 for _ in range(60)), " " * 1500])
def test_pieces_round_trip(spark, text):
    items = spark.createDataFrame([("curated", 1, text), ("curated", 1, text), ("curated", 2, "short"), ("curated", 3, None), ("chunk", 4, ""), ("other", 5, text)], "item_kind string, item_id long, text string")
    pieces = chunking.split_items(items, limits(spark)).orderBy("piece_no").collect()
    assert {r.item_id for r in pieces} == {1} and [r.piece_no for r in pieces] == list(range(len(pieces)))
    assert all(len(r.text) <= 500 and r.text == text[r.start_pos : r.end_pos] for r in pieces)
    assert "".join(r.text[r.overlap :] for r in pieces) == text
    assert all(b.start_pos == a.end_pos - 40 and b.overlap == 40 for a, b in itertools.pairwise(pieces))
    assert [tuple(r) for r in chunking.found_items(chunking.split_items(items, limits(spark))).collect()] == [("curated", 1)]


def test_cuts_fall_between_comments_and_edits_stay_local():
    cuts = chunking.cuts(TEXT, 500, 40)
    assert {k for _, k in cuts[:-1]} == {"comment"} and all(TEXT[e - 1] == "\n" for e, _ in cuts[:-1])
    at = TEXT.index("user100 ")
    edited = TEXT[:at] + "user99x (member):inserted.\n" + TEXT[at:]
    pieces = lambda t: {t[a:b] for a, b in itertools.pairwise([0, *(e for e, _ in chunking.cuts(t, 500, 40))])}
    assert len(pieces(TEXT) - pieces(edited)) <= 4


def test_limit_must_be_positive():
    with pytest.raises(ValueError, match="positive"):
        chunking.cuts("x", 0, 0)


SCHEMA = "artifact_id long, extracted_at timestamp, type string, tags array<string>, items string"


def test_pairs_against_brute_force(spark):
    rng = random.Random(1)
    names = [f"t{k}" for k in range(40)]
    baskets = [rng.choices(names, [1 / (k + 1) for k in range(40)], k=rng.randrange(0, 7)) for _ in range(800)]
    df = spark.createDataFrame([([*b, None, b[0] if b else None],) for b in baskets], "items array<string>")
    sets = [set(b) for b in baskets]
    one, two = Counter(x for s in sets for x in s), Counter(p for s in sets for p in itertools.combinations(sorted(s), 2))
    for least, lift in ((10, 0.0), (3, 1.5)):
        want = {p: n for p, n in two.items() if n >= least and n * 800 >= lift * one[p[0]] * one[p[1]]}
        got = {(r.item_a, r.item_b): r for r in cooccur.cooccurrence(df, least, 0.0, lift).collect()}
        assert {p: r.n_ab for p, r in got.items()} == want
        assert all(math.isclose(r.lift, r.n_ab * 800 / (r.n_a * r.n_b)) and (r.n_a, r.n_b) == (one[p[0]], one[p[1]]) for p, r in got.items())
    assert {(r.item_a, r.item_b): r.n for r in cooccur.pair_counts(df, None).collect()} == dict(two)


@pytest.mark.parametrize(("held", "skew"), [(1_000_000, 0.0), (1_000_000, 1.0), (300, 1.0), (50, 0.3)])
def test_gram_in_blocks(spark, held, skew):
    """Thousands of items, frequent and rare, over several record blocks, and with so little room that sums leave early."""
    rng = random.Random(2)
    names, weight = [f"i{k}" for k in range(1500)], [1 / (k + 1) ** skew for k in range(1500)]
    sets = [set(rng.choices(names, weight, k=rng.randrange(0, 9))) for _ in range(9000)]
    df = spark.createDataFrame([(sorted(s),) for s in sets], "items array<string>").coalesce(1)
    got = {(r.item_a, r.item_b): r.n for r in cooccur.pair_counts(df, held=held).collect()}
    assert got == dict(Counter(p for s in sets for p in itertools.combinations(sorted(s), 2)))
    some = set(names[:40])
    got = {(r.item_a, r.item_b): r.n for r in cooccur.pair_counts(df, sorted(some), held=held).collect()}
    assert got == dict(Counter(p for s in sets for p in itertools.combinations(sorted(s & some), 2)))


def test_a_basket_with_very_many_items(spark):
    df = spark.createDataFrame([([f"x{k}" for k in range(700)],), (["x1", "x2"],), ([],), (None,)], "items array<string>")
    got = {(r.item_a, r.item_b): r.n_ab for r in cooccur.cooccurrence(df, 1, 0.0).collect()}
    assert len(got) == 700 * 699 // 2 and got["x1", "x2"] == 2


def test_baskets(spark):
    from datetime import datetime

    rows = [(1, datetime(2021, 1, 1), "Old", ["x"], ""), (1, datetime(2021, 1, 2), "New Type", ["\tBug-fix ", "bug_fix", None, " "], ""), (2, None, None, None, "")]
    got = {r.artifact_id: sorted(r["items"]) for r in cooccur.artifact_baskets(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: ["tag:bug_fix", "type:new_type"], 2: []}
    assert cooccur.cooccurrence(cooccur.artifact_baskets(spark.createDataFrame([], SCHEMA))).count() == 0


def test_packing(spark):
    rng = random.Random(4)
    sizes = [(k, rng.choice((0, rng.randrange(1, 90), rng.randrange(1, 400)))) for k in range(3000)] + [(9000, 512 * 3), (9001, None)]
    df = spark.createDataFrame(sizes + sizes[:10], "doc_id long, n_tokens long")
    kinds = spark.createDataFrame([("a", 100, "z"), ("b", 512, "z"), ("none", 0, "z"), ("null", None, "z")], "container_kind string, capacity_tokens int, fill string")
    rows = packing.pack(df, kinds, group=1000).collect()
    for kind, cap in (("a", 100), ("b", 512)):
        own = [r for r in rows if r.container_kind == kind]
        held = Counter()
        for r in own:
            held[r.container_id] += r.n_tokens
        assert max(held.values()) <= cap
        docs = Counter()
        for r in own:
            docs[r.doc_id] += r.n_tokens
            assert r.token_start == r.piece_no * cap
        assert docs == Counter({k: n or 0 for k, n in sizes}) and set(docs) == {k for k, _ in sizes}
        assert all(r.piece_no == 0 for r in own if (dict(sizes)[r.doc_id] or 0) <= cap)
        assert len([c for c, n in held.items() if n]) <= math.ceil(sum(held.values()) / cap) * 1.03 + 4
    assert {r.container_kind for r in rows} == {"a", "b"}
    empty = spark.createDataFrame([], "doc_id long, n_tokens long")
    assert packing.pack(empty, kinds).count() == packing.pack(df, kinds.where("false")).count() == packing.fill(packing.pack(empty, kinds)).count() == 0


def test_placement_makes_the_squares_smallest():
    rng = random.Random(6)
    p, gaps = packing.SumOfSquares(20), Counter()
    for _ in range(300):
        s = rng.randrange(1, 21)

        def squares(change):
            g = Counter(gaps)
            g.update(change)
            return sum(n * n for k, n in g.items() if k > 0)

        options = [squares({20 - s: 1})] + [squares({g: -1, g - s: 1}) for g, n in gaps.items() if n > 0 and s <= g < 20]
        p.place(s)
        now = Counter({g: int(n) for g, n in enumerate(p.count) if n})
        assert sum(n * n for n in now.values()) == min(options)
        gaps = now


def test_pfair_stays_within_a_block():
    w = {"a": Fraction(1, 2), "b": Fraction(3, 10), "c": Fraction(1, 5)}
    done = Counter()
    for t, s in enumerate(mixing.pfair(w, 1000), 1):
        done[s] += 1
        assert all(abs(done[x] - w[x] * t) < 1 for x in w)


def test_mix(spark):
    rng = random.Random(8)
    docs = [(k, rng.choice(("big", "Big ", "small", "SMALL", "unlisted", None)), rng.randrange(0, 50), "e") for k in range(4000)]
    docs += [(k + 10_000, "big", 30, "e") for k in range(3000)]
    df = spark.createDataFrame(docs + docs[:5], "doc_id long, source string, n_tokens long, passes string")
    target = spark.createDataFrame([("big", 0.4, 1, "q"), ("small", 0.6, 3, "q"), (None, 0.1, 2, "q")], "source string, target_share double, max_repeats int, passes string")
    m = mixing.Mix(df, target, blocks=100)
    shares = {r.source: r for r in m.shares().collect()}
    assert abs(shares["big"].actual_share - 0.4) < 0.01 and abs(shares["small"].actual_share - 0.6) < 0.01
    used = m.chosen().collect()
    assert len({r.doc_id for r in used}) == len(used) and all(r.times_used <= (1 if r.source == "big" else 3) for r in used)
    clean = {k: (s or "").strip().lower() for k, s, _, _ in docs}
    total = {s: sum(n for k, _, n, _ in docs if clean[k] == s) for s in ("big", "small")}
    most = min(total["big"] / 0.4, 3 * total["small"] / 0.6)
    assert m.blocks == 100 and sum(m.granted.values()) == 100 and abs(sum(r.used_tokens for r in shares.values()) - 100 * m.size) < 100 and 100 * m.size > most - 100
    order = m.ordered().orderBy("block_time", "in_block", "doc_id").collect()
    assert Counter(r.doc_id for r in order) == Counter({r.doc_id: r.times_used for r in used})
    # at the end of every block each source is off its share by less than one block and half a document
    used_at = Counter()
    for r in order:
        used_at[r.source, r.block_time] += r.n_tokens
    seen = Counter()
    for t in range(m.blocks):
        for s, w in (("big", 0.4), ("small", 0.6)):
            seen[s] += used_at[s, t]
            assert abs(seen[s] - w * (t + 1) * m.size) < m.size + 25
    # the chosen documents are those that fill the granted blocks: brute force over the order of each source
    place = {(r.doc_id): r.before for r in m.placed().collect()}
    for s, cap in (("big", 1), ("small", 3)):
        for k, _, n, _ in docs:
            if clean[k] == s:
                want = sum(2 * (u * total[s] + place[k]) + n < 2 * m.granted[s] * m.size for u in range(cap))
                assert want == next((r.times_used for r in used if r.doc_id == k), 0)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, source string, n_tokens long")
    target = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    m = mixing.Mix(df, target)
    assert m.chosen().count() == m.ordered().count() == 0 and m.shares().first().actual_share == 0
    assert mixing.Mix(df, target.where("false")).shares().count() == 0


def test_listed_sources_without_tokens_take_nothing_from_the_others(spark):
    docs = [(k, "a", 10) for k in range(300)] + [(1000 + k, "b", 10) for k in range(200)] + [(5000, "blank", 0), (5001, "blank", None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, n_tokens long")
    target = spark.createDataFrame([("a", 0.3, 1), ("b", 0.2, 2), ("absent", 0.4, 1), ("blank", 0.1, 1)], "source string, target_share double, max_repeats int")
    m = mixing.Mix(df, target, blocks=50)
    shares = {r.source: (r.used_tokens, r.actual_share, round(r.target_share, 6)) for r in m.shares().collect()}
    assert shares == {"a": (3000, 0.6, 0.3), "b": (2000, 0.4, 0.2), "absent": (0, 0, 0.4), "blank": (0, 0, 0.1)}
    assert m.chosen().count() == m.ordered().count() == 500


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world", "s"), (2, "", "s"), (3, None, "s"), (4, "a" * 20_000, "s")], "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(df, "doc_id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] == len(tokens.encoder().encode_ordinary("a" * 20_000))
