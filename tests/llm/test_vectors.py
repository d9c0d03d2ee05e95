import itertools

import numpy as np
import pytest

from lodeline.llm import clusters, mutual, neighbours, subset
from lodeline.llm.cliques import leaders, overlapping

DIM = 128
SCHEMA = "vec_id bigint, embedding array<float>"


def planted(seed=0, groups=((40, 0.03), (25, 0.07), (30, 0.35), (8, 0.35), (6, 0.02), (3, 0.1)), noise=150, copies=60):
    """Groups around random centres, noise, and copies of one vector, of various lengths and in no order."""
    rng = np.random.default_rng(seed)
    x = []
    for n, s in groups:
        c = rng.standard_normal(DIM)
        c /= np.linalg.norm(c)
        x.append(c + s * rng.standard_normal((n, DIM)) / np.sqrt(DIM))
    x.append(rng.standard_normal((noise, DIM)))
    x.append(np.repeat(rng.standard_normal((1, DIM)), copies, 0))
    x = np.vstack(x) * 10.0 ** rng.integers(-2, 3, size=(sum(n for n, _ in groups) + noise + copies, 1))
    x[-copies:] = x[-1]
    return x.astype(np.float32)[rng.permutation(len(x))]


def frame(spark, x):
    d = spark.createDataFrame([(i * 3 + 1, v.tolist()) for i, v in enumerate(x)], SCHEMA)
    return d.selectExpr("*", "1 AS v", "'a' AS h", "0 AS cell")


def scores(x):
    u = neighbours.unit(x)
    return (1 + u @ u.T) / 2


def brute_sets(x, least_score, least):
    """The components are cliques here, which is asserted."""
    near = scores(x).round(9) >= least_score
    seen, out = set(), set()
    for i in range(len(x)):
        if i not in seen:
            m = np.flatnonzero(near[i])
            assert near[np.ix_(m, m)].all() and all(set(np.flatnonzero(near[j])) == set(m) for j in m)
            seen |= set(m.tolist())
            if len(m) >= least:
                out |= {(int(m[0]) * 3 + 1, int(j) * 3 + 1) for j in m}
    return out


def brute_pairs(x, k, least_score):
    s = scores(x).round(9)
    np.fill_diagonal(s, -1)
    out = set()
    for i, r in enumerate(s):
        for j in np.lexsort((np.arange(len(x)), -r))[:k]:
            if r[j] >= least_score:
                out.add((min(i, j) * 3 + 1, max(i, j) * 3 + 1))
    return out


@pytest.fixture(scope="module")
def books(spark):
    rng = np.random.default_rng(9)
    rows = [(m, c, j, float(rng.standard_normal())) for m in range(16) for c in range(3) for j in range(8)]
    rows += rows[:5] + [(0, 3, 0, None), (None, 1, 1, 1.0)]
    return spark.createDataFrame(rows, "m int, code int, j int, cx double")


def pairs_of(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("seed", [0, 1])
def test_crowds(spark, books, seed):
    x = planted(seed)
    got = pairs_of(subset.crowds(frame(spark, x), books))
    want = brute_sets(x, 0.985, 20)
    assert got == sorted(want)
    assert pairs_of(subset.crowds(frame(spark, x), books, cell=40, hot=60)) == got


@pytest.mark.parametrize("seed", [0, 1])
def test_tight_clusters(spark, seed):
    x = planted(seed)
    got = pairs_of(clusters.tight_clusters(frame(spark, x), 20))
    assert got == sorted(brute_sets(x, 0.90, 5))


def test_hot_cells_are_cut(spark):
    x = planted(2)
    assert pairs_of(clusters.tight_clusters(frame(spark, x), 3, hot=50)) == sorted(brute_sets(x, 0.90, 5))


@pytest.mark.parametrize("group, hot", [(24576, 32768), (40, 10)])
def test_neighbours(spark, group, hot):
    x = planted(3)
    got = set(pairs_of(neighbours.similar_pairs(neighbours.knn(frame(spark, x), 5, 0.90, group=group, hot=hot))))
    want = brute_pairs(x, 5, 0.90)
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_neighbours_in_far_more_sets_than_centroids(spark, monkeypatch):
    """As in a large table: a sample that misses most sets, and cells that each hold parts of many."""
    monkeypatch.setattr(neighbours, "MOST_CENTROIDS", 16)
    monkeypatch.setattr(neighbours, "SAMPLE", 512)
    x = planted(8, groups=((8, 0.35),) * 600, noise=800)
    got = set(pairs_of(neighbours.similar_pairs(neighbours.knn(frame(spark, x), 5, 0.90, group=300))))
    want = brute_pairs(x, 5, 0.90)
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)


def test_neighbour_rows(spark):
    x = planted(4)
    r = neighbours.knn(frame(spark, x), 5).collect()
    s = scores(x).round(9)
    assert all(abs(s[(a.vec_id - 1) // 3, (a.neighbour - 1) // 3] - a.score) < 2e-9 and a.vec_id != a.neighbour for a in r)
    by = {k: [(a.rk, a.score) for a in sorted(g, key=lambda a: a.rk)] for k, g in itertools.groupby(sorted(r, key=lambda a: a.vec_id), key=lambda a: a.vec_id)}
    assert all([n for n, _ in v] == list(range(1, len(v) + 1)) and [b for _, b in v] == sorted((b for _, b in v), reverse=True) for v in by.values())


@pytest.mark.parametrize("slice_bytes", [16 << 20, 100 * 512])
def test_lists_of_all_vectors(spark, slice_bytes):
    """Also of those that resemble nothing: most of their neighbours score below 0.7."""
    x = planted(7, noise=1500)
    got = {}
    for r in neighbours.knn_lists(frame(spark, x), 5, slice_bytes=slice_bytes).collect():
        got.setdefault((r.vec_id - 1) // 3, []).append((r.rk, (r.neighbour - 1) // 3, r.score))
    s = scores(x).round(9)
    np.fill_diagonal(s, -1)
    true = [np.lexsort((np.arange(len(x)), -r))[:5] for r in s]
    assert len(got) == len(x) and all(sorted(n for n, _, _ in g) == [1, 2, 3, 4, 5] and len({j for _, j, _ in g}) == 5 for g in got.values())
    assert all(abs(s[i, j] - c) < 2e-9 for i, g in got.items() for _, j, c in g)
    kth = np.array([s[i, t[-1]] for i, t in enumerate(true)])
    hit = np.array([sum(c >= kth[i] - 2e-9 for _, _, c in got[i]) for i in range(len(x))])
    assert hit.sum() >= 0.98 * 5 * len(x) and (hit[kth < 0.88] == 5).all()


def test_few_or_no_rows(spark, books):
    none = frame(spark, planted(0)).limit(0)
    assert neighbours.knn(none, 5).count() == clusters.tight_clusters(none).count() == subset.crowds(none, books).count() == subset.varied_subset(none, books, 5).count() == 0
    one = frame(spark, planted(0)[:1])
    assert neighbours.knn(one, 5).count() == 0 and clusters.tight_clusters(one, least=1).count() == 1
    two = frame(spark, np.repeat(planted(0)[:1], 2, 0))
    assert pairs_of(neighbours.similar_pairs(neighbours.knn(two, 5, 0.9))) == [(1, 4)]


def test_varied_subset(spark, books):
    x = np.vstack([planted(5, noise=100, copies=300)])
    d = frame(spark, x)
    got = subset.varied_subset(d, books, 120).collect()
    assert len(got) == 120 == len({r.vec_id for r in got})
    cells = {r.cell for r in subset.varied_subset(d, books, 10**6).collect()}
    assert subset.varied_subset(d, books, 10**6).count() == len(x)
    # by rank, then cell: of the last rank the cells that come first, of those before it all
    ranks, last = {r.cell: 0 for r in got}, max(r.rk for r in got)
    for r in got:
        ranks[r.cell] = max(ranks[r.cell], r.rk)
    assert len(ranks) <= len(cells) and all(sorted(r.rk for r in got if r.cell == c) == list(range(1, n + 1)) for c, n in ranks.items())
    copies = {i * 3 + 1 for i in np.flatnonzero((x == x[np.unique(x, axis=0, return_inverse=True)[1].argmax()]).all(1))}
    assert last < 40 and len({r.vec_id for r in got} & copies) <= last
    assert subset.varied_subset(d, books, 0).count() == 0
    assert subset.varied_subset(d, books.limit(0), 7).count() == 7


def test_describe(spark):
    x = planted(6)
    p = clusters.pack(frame(spark, x), DIM)
    m = clusters.fit(p, len(x), 10, DIM)
    rows = clusters.describe(p, m, DIM, 3).collect()
    sizes = {r.cluster: r.size for r in rows}
    assert sum(sizes.values()) == len(x) and all(r.rk <= 3 for r in rows)


def test_leaders():
    g, lead = leaders(np.eye(3)[[0, 1, 0, 2]], 0.5)
    assert g.tolist() == [0, 1, 0, 2] and lead.tolist() == [0, 1, 3]


def test_configured_lists(spark):
    rows = [(1, 64, "2023-01-01"), (2, 100, "2023-02-01"), (3, None, "2023-03-01"), (3, None, "2023-03-01")]
    d = spark.createDataFrame(rows, "config_id int, nlist int, created_at string")
    assert clusters.nlist_of(d) == 100 and clusters.nlist_of(d.limit(0), 7) == 7


def with_cosines(gram, noise=120, seed=0):
    """Vectors of the given cosines, first, and noise."""
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.standard_normal((DIM, DIM)))[0]
    x = np.zeros((len(gram), DIM))
    x[:, : len(gram)] = np.linalg.cholesky(gram)
    return np.vstack([x @ turn, rng.standard_normal((noise, DIM))]).astype(np.float32)


def even(n, cos):
    return np.full((n, n), cos) + (1 - cos) * np.eye(n)


def maximal_members(near, least):
    """(first row, row) of all maximal sets, by plain recursion."""
    out, nb = set(), [set(np.flatnonzero(r).tolist()) - {i} for i, r in enumerate(near)]

    def go(taken, may, done):
        if not may and not done and len(taken) >= least:
            out.update((min(taken) * 3 + 1, v * 3 + 1) for v in taken)
        for v in sorted(may):
            go(taken | {v}, may & nb[v], done & nb[v])
            may, done = may - {v}, done | {v}

    go(set(), set(range(len(near))), set())
    return out


def bordered(n, inside, near, far, of):
    """Row 0 is near to ``of`` of the n others, which are a set."""
    g = even(n + 1, inside)
    g[0, 1 : of + 1] = g[1 : of + 1, 0] = near
    g[0, of + 1 :] = g[of + 1 :, 0] = far
    return g


@pytest.mark.parametrize("k", [1, 12])
@pytest.mark.parametrize("case", ["border", "pair"])
def test_clusters_that_touch_others(spark, case, k):
    """A vector outside that leads some of the members, and four vectors without a set of five."""
    g = bordered(5, 0.9, 0.82, 0.78, 3) if case == "border" else even(4, 0.85)
    if case == "pair":
        g[1, 2] = g[2, 1] = 0.78
    x = with_cosines(g)
    want = maximal_members(scores(x).round(9) >= 0.90, 5)
    assert len(want) == (5 if case == "border" else 0)
    assert set(pairs_of(clusters.tight_clusters(frame(spark, x), k))) == want


def test_members_of_overlapping_sets():
    rng = np.random.default_rng(0)
    for turn in range(60):
        n, p, least = int(rng.integers(2, 10)), rng.random(), int(rng.integers(1, 6))
        near = rng.random((n, n)) < p
        near = near | near.T | np.eye(n, dtype=bool)
        got = {(c * 3 + 1, v * 3 + 1) for c, m in overlapping(near, np.ones(n, int), least) for v in m}
        assert got == maximal_members(near, least), turn


def test_crowd_beside_a_vector(spark, books):
    """The vector has the smallest id and is near to 15 of the 20 members."""
    x = with_cosines(bordered(20, 0.985, 0.972, 0.968, 15))
    assert pairs_of(subset.crowds(frame(spark, x), books)) == [(4, i * 3 + 1) for i in range(1, 21)]


def test_crowds_of_many_sets(spark, books):
    """Seven far pairs give 128 maximal sets of 23 vectors."""
    g = even(30, 0.98)
    for i in range(7):
        g[i, i + 7] = g[i + 7, i] = 0.968
    x = with_cosines(g)
    sets = [{*pick, *range(14, 30)} for pick in itertools.product(*((i, i + 7) for i in range(7)))]
    want = {(min(s) * 3 + 1, v * 3 + 1) for s in sets for v in s}
    assert {v for _, v in want} == {i * 3 + 1 for i in range(30)}
    assert set(pairs_of(subset.crowds(frame(spark, x), books))) == want
    assert set(pairs_of(clusters.tight_clusters(frame(spark, x), 3, min_score=0.985, least=20))) == want


def blob(n, angle, seed):
    """n distinct vectors around one direction."""
    rng = np.random.default_rng(seed)
    c = rng.standard_normal(DIM)
    return c / np.linalg.norm(c) + np.tan(np.radians(angle)) * rng.standard_normal((n, DIM)) / np.sqrt(DIM)


def test_clumps_and_shared_members(spark, books):
    """24 vectors in two clumps, 10 degrees apart; and two crowds of 22 that share 12."""
    g = np.block([[even(12, 0.9999), np.full((12, 12), 0.9848)], [np.full((12, 12), 0.9848), even(12, 0.9999)]])
    assert pairs_of(subset.crowds(frame(spark, with_cosines(g)), books)) == [(1, i * 3 + 1) for i in range(24)]
    g = even(32, 0.973)
    g[:10, 22:] = g[22:, :10] = 0.968
    want = {(1, i * 3 + 1) for i in range(22)} | {(31, i * 3 + 1) for i in range(10, 32)}
    assert set(pairs_of(subset.crowds(frame(spark, with_cosines(g)), books))) == want


def test_half_of_all_rows_in_one_place(spark, books):
    """Distinct vectors that no point divides: blocks hold them, and no task has more than two blocks."""
    rng = np.random.default_rng(3)
    x = np.vstack([blob(300, 3, 1), blob(30, 3, 2), rng.standard_normal((270, DIM))]).astype(np.float32)[rng.permutation(600)]
    want = sorted(brute_sets(x, 0.985, 20))
    assert len(want) == 330
    assert pairs_of(subset.crowds(frame(spark, x), books, cell=100, hot=40)) == want
    assert pairs_of(clusters.tight_clusters(frame(spark, x), 5, min_score=0.985, least=20, hot=40)) == want


def test_chain_of_sets(spark):
    """Three sets of which neighbours are joined by one near pair: joined parts are checked pair by pair."""
    g = np.full((18, 18), 0.5) + 0.5 * np.eye(18)
    for i in range(3):
        g[6 * i : 6 * i + 6, 6 * i : 6 * i + 6] = even(6, 0.9)
    for a, b in ((5, 6), (11, 12)):
        g[a, b] = g[b, a] = 0.802
    w, v = np.linalg.eigh(g)
    g = (v * np.maximum(w, 1e-6)) @ v.T
    x = with_cosines(g / np.sqrt(np.outer(np.diag(g), np.diag(g))))
    want = maximal_members(scores(x).round(9) >= 0.90, 5)
    for k in (1, 6, 30):
        assert set(pairs_of(clusters.tight_clusters(frame(spark, x), k))) == want


def test_labels_between_blocks():
    rng = np.random.default_rng(1)
    for _ in range(20):
        x, y = (neighbours.unit(rng.standard_normal((n, 3))) for n in (9, 7))
        lx, ly = mutual.across(x, y, np.arange(9), np.arange(20, 27), 0.9)
        near = x @ y.T >= 0.9
        assert (lx[near.any(1)] <= np.flatnonzero(near.any(1))).all() and all(lx[i] == ly[j] for i, j in zip(*np.nonzero(near))) and (lx[~near.any(1)] == mutual._NONE).all()
        assert mutual.near_weight(x, y, np.arange(7), 0.9).tolist() == (near @ np.arange(7)).tolist()


def test_crowd_far_over_a_border(spark, monkeypatch):
    """Two clumps 13.8 degrees apart, one on each side of a border between points at right angles."""
    rng = np.random.default_rng(4)
    turn = np.radians(np.repeat([38.1, 51.9], 10))
    x = np.zeros((320, DIM))
    x[:20, 0], x[:20, 1] = np.cos(turn), np.sin(turn)
    x[:20, 2:] = 1e-4 * rng.standard_normal((20, DIM - 2))
    x[20:] = rng.standard_normal((300, DIM))
    cells = subset.Places(np.eye(DIM)[:12], 0.985) if hasattr(subset, "Places") else mutual.Cells(np.eye(DIM)[:12], whole=True)
    got = mutual.mutual_sets(mutual.pack(frame(spark, x.astype(np.float32)), DIM), cells, 0.985, 20, DIM, {})
    assert pairs_of(got) == [(1, i * 3 + 1) for i in range(20)]


def test_borders_are_met_by_slices_of_near_cells(spark, books, monkeypatch):
    """Vectors meet only the slices of cells within reach, and the sets are whole however many slices there are."""
    rng = np.random.default_rng(6)
    turned = lambda i, n, far: np.eye(DIM)[np.full(n, i)] + far * rng.standard_normal((n, DIM))
    points = neighbours.unit(np.concatenate([turned(i, 3, 0.02) for i in range(8)])).astype(np.float32)
    cells = mutual.Cells(points, whole=True)
    cells.slices = np.repeat(np.arange(8), 3)
    row, to = cells.slices_within(neighbours.unit(turned(2, 50, 0.005)), 6, mutual._far(0.97))
    assert set(to) == {cells.slices[6]} and set(row) == set(range(50))
    x = np.concatenate([turned(i, 30, 0.012) for i in range(6)]).astype(np.float32)
    arc = np.random.default_rng(0).permutation(40) / 40
    of = mutual.slices_of(np.stack([np.cos(arc), np.sin(arc)], 1), dict.fromkeys(range(40), 10), 100)
    assert np.bincount(of).tolist() == [10, 10, 10, 10] and all(np.ptp(arc[of == s]) < 0.25 for s in range(4))
    monkeypatch.setattr(mutual, "SLICE_BYTES", 20 * DIM * 2)
    assert set(pairs_of(subset.crowds(frame(spark, x), books, cell=6))) == brute_sets(x, 0.985, 20)
