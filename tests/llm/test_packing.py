import base64
import random
from collections import defaultdict

import pytest
from tests.llm.awkward import ROWS, awkward, documents, empty
from trendloom.llm.capacity_tree import CapacityTree
from trendloom.llm.token_packing import best_fit_decreasing, packed_rows, split, unpacked, write_packed
from trendloom.llm.variable_packing import Lengths, _packed, filled, pack, packed_documents


@pytest.fixture(scope="module")
def encode():
    """The library itself, on whole texts."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def best_fit(sizes, capacity):
    """Best fit decreasing by looking at every bin; the bin last given its room comes first."""
    bins, rooms = [], []
    for item in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        fitting = [(free, -turn, b) for b, (free, turn) in enumerate(rooms) if free >= sizes[item]]
        if fitting:
            free, _, b = min(fitting)
        else:
            free, b = capacity, len(bins)
            bins.append([])
            rooms.append(None)
        bins[b].append(item)
        rooms[b] = (free - sizes[item], sum(map(len, bins)))
    return bins


def test_tree_finds_the_tightest_bin():
    draw = random.Random(1)
    tree, free = CapacityTree(40), {}
    for turn in range(3000):
        if draw.random() < 0.5:
            free[turn] = draw.randrange(41)
            tree.put(free[turn], turn)
        else:
            size = draw.randrange(41)
            found = tree.take(size)
            fitting = [f for f in free.values() if f >= size]
            assert (found[0] if found else None) == (min(fitting) if fitting else None)
            if found:
                assert free.pop(found[1]) == found[0]


def test_best_fit_decreasing_against_brute_force():
    draw = random.Random(2)
    for _ in range(100):
        sizes = [draw.randrange(33) for _ in range(draw.randrange(40))]
        assert best_fit_decreasing(sizes, 32) == best_fit(sizes, 32)


def test_split_loses_nothing():
    assert split(0, 4) == [(0, 0)]
    assert split(9, 4) == [(0, 4), (4, 4), (8, 1)]
    assert split(8, 4) == [(0, 4), (4, 4)]


def round_trip(packed):
    found = defaultdict(list)
    for row in sorted(unpacked(packed).collect(), key=lambda r: (r.doc_id is None, r.doc_id, r.offset)):
        found[row.doc_id].append((row.offset, row.ids))
    return found


def test_documents_come_back(spark, sf_dir, encode):
    docs = documents(spark, sf_dir)
    packed = write_packed(docs, row_tokens=300)
    found = round_trip(packed)
    for row in docs.collect():
        ids = [i for _, part in found[row.doc_id] for i in part]
        assert ids == encode(row.text)
    for row in packed.collect():
        assert len(row.ids) == 600 and row.lengths[0] == 0 and row.lengths[-1] == row.n_tokens <= 300
        assert row.resets == [a for a, b in zip(row.lengths, row.lengths[1:]) if b > a]
        assert not any(row.ids[2 * row.n_tokens :])


def test_awkward_rows_come_back(spark, encode):
    found = round_trip(packed_rows(awkward(spark)))
    expected = defaultdict(list)
    for doc_id, text, *_ in ROWS:
        expected[doc_id] += encode(text or "")
    assert {k: sorted(i for _, part in v for i in part) for k, v in found.items()} == {
        k: sorted(v) for k, v in expected.items()
    }
    assert packed_rows(empty(spark)).count() == 0


def test_bins_are_downsized_and_hold_everything():
    draw, lengths = random.Random(3), Lengths((8, 16, 64), 1.0, 50.0)
    for _ in range(100):
        sizes = [draw.randrange(65) for _ in range(draw.randrange(60))]
        bins = pack(sizes, lengths)
        assert sorted(i for _, items in bins for i in items) == list(range(len(sizes)))
        for capacity, items in bins:
            used = sum(sizes[i] for i in items)
            assert capacity == min(n for n in (8, 16, 64) if n >= used)


def test_costs_decide_what_is_opened():
    sizes = [4] * 32
    short, long = Lengths((8, 64), 0.0, 10.0), Lengths((8, 64), 100.0, 1e9)
    assert {c for c, _ in pack(sizes, short)} == {8}
    assert {c for c, _ in pack(sizes, long)} == {64}


def check_packed(rows, counts, longest=8192):
    """Pieces tile their documents, and segments tile their bins."""
    pieces, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.piece, r.n_tokens))
        bins[r.bin].append(r)
    for doc_id, expected in counts.items():
        sizes = sorted(n for total in expected for _, n in split(total, longest))
        assert sorted(n for _, n in pieces[doc_id]) == sizes
    for inside in bins.values():
        assert len({(r.capacity, r.used) for r in inside}) == 1 and inside[0].used <= inside[0].capacity
        at = 0
        for r in sorted(inside, key=lambda r: (r.start, r.n_tokens)):
            assert r.start == at
            at += r.n_tokens
        assert at == inside[0].used


def test_variable_packing_of_documents(spark, sf_dir, encode):
    docs = documents(spark, sf_dir)
    counts = {r.doc_id: [len(encode(r.text))] for r in docs.collect()}
    check_packed(packed_documents(docs).collect(), counts)


def test_variable_packing_of_awkward_rows(spark, encode):
    counts = defaultdict(list)
    for doc_id, text, *_ in ROWS:
        counts[doc_id].append(len(encode(text or "")))
    check_packed(packed_documents(awkward(spark)).collect(), counts)
    assert packed_documents(empty(spark)).count() == 0


def cheapest(sizes, lengths):
    """The least cost of all partitions of the items into bins."""
    best = {0: 0.0}
    for done in range(1 << len(sizes)):
        if done not in best:
            continue
        rest = [i for i in range(len(sizes)) if not done >> i & 1]
        if not rest:
            continue
        others = rest[1:]
        for some in range(1 << len(others)):
            chosen = [rest[0]] + [i for place, i in enumerate(others) if some >> place & 1]
            holding = [n for n in lengths.permitted if n >= sum(sizes[i] for i in chosen)]
            if holding:
                after = done | sum(1 << i for i in chosen)
                cost = best[done] + lengths.cost(holding[0])
                best[after] = min(best.get(after, cost), cost)
    return best[(1 << len(sizes)) - 1]


def longest_first(sizes):
    return sorted(range(len(sizes)), key=lambda i: -sizes[i])


def cost_of(bins, lengths):
    return sum(lengths.cost(length) for length, _ in bins)


def test_cost_is_near_the_least_of_all_assignments():
    draw, lengths, ratios = random.Random(4), Lengths((4, 8, 16), 2.0, 24.0), []
    for _ in range(60):
        sizes = [draw.randrange(1, 17) for _ in range(draw.randrange(1, 8))]
        ratios.append(cost_of(pack(sizes, lengths), lengths) / cheapest(sizes, lengths))
    assert min(ratios) >= 1 - 1e-9 and max(ratios) < 1.25 and sum(ratios) / 60 < 1.03


def test_joint_choice_costs_no_more_than_any_single_length():
    draw, lengths = random.Random(6), Lengths()
    opened = set()
    for spread in (300, 900, 3000, 8000):
        sizes = [min(8192, 1 + int(draw.expovariate(1 / spread))) for _ in range(400)]
        bins = pack(sizes, lengths)
        opened |= {length for length, _ in bins}
        for single in lengths.permitted:
            if max(sizes) <= single:
                alone = best_fit(sizes, single)
                assert cost_of(bins, lengths) <= len(alone) * lengths.cost(single) + 1e-6
            cost, _ = _packed(sizes, longest_first(sizes), lengths, single)
            assert cost_of(bins, lengths) <= cost
    assert len(opened) > 2


def test_opened_length_depends_on_what_is_left():
    lengths = Lengths((8, 16, 32), 2.0, 1e9)
    opened = lambda sizes: sorted(length for length, _ in _packed(sizes, longest_first(sizes), lengths, None)[1])
    assert opened([7] * 2) == [16] and opened([7]) == [8] and opened([7] * 8) == [32, 32]
    assert filled([-7, -5, -5, -1, 0], 0, 11) == 8 and filled([-7, -5], 1, 4) == 0
