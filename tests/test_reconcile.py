"""Two logs compared as a tree: only ranges that differ are opened, and exactly the rows that differ come out."""

from ladderwork.operators.reconcile import ReconcileParams, differences, differing, leaf_digests

SCHEMA = "season long, player_id long, game_id long, rating double, note string"
KEYS, VALUES = ["player_id", "game_id"], ["rating", "note"]


def log():
    return [(s, p, 100 * p + g, float(s + p * g), "x" if g % 3 else None) for s in range(1990, 2000) for p in range(30) for g in range(5)]


def shown(df):
    return sorted((r.season or 0, r.player_id, r.game_id, r.kind, r.columns or "") for r in df.collect())


def test_equal_logs_open_nothing(spark):
    p = ReconcileParams(fan=4, levels=3)
    a, b = (spark.createDataFrame(rows, SCHEMA).repartition(n) for rows, n in ((log(), 3), (log()[::-1], 5)))
    leaves, seen = differing(leaf_digests(a, "season", KEYS, VALUES, p), leaf_digests(b, "season", KEYS, VALUES, p), p)
    assert leaves.count() == 0 and seen[0] == (10, 0) and all(n == 0 for n, _ in seen[1:])
    assert differences(a, b, "season", KEYS, VALUES, p).count() == 0


def test_rows_that_differ(spark):
    rows, other = log(), log()
    changed = {17: (3, 5.25, "x"), 700: (4, 1.0, "new")}
    for k, (_, rating, note) in changed.items():
        other[k] = (*other[k][:3], rating, note)
    lost = other.pop(1200)
    other += [(1995, 999, 1, None, None), (None, 1, 1, 2.0, "z"), rows[5]]
    a, b, p = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(other, SCHEMA), ReconcileParams(fan=8, levels=2)
    want = [(rows[k][0], *rows[k][1:3], "changed", ",".join(c for c, x, y in zip(VALUES, rows[k][3:], other_row[1:]) if x != y)) for k, other_row in changed.items()]
    want += [(*lost[:3], "only_left", ""), (1995, 999, 1, "only_right", ""), (0, 1, 1, "only_right", ""), (*rows[5][:3], "only_right", "")]
    assert shown(differences(a, b, "season", KEYS, VALUES, p)) == sorted(want)
    leaves, seen = differing(leaf_digests(a, "season", KEYS, VALUES, p), leaf_digests(b, "season", KEYS, VALUES, p), p)
    assert leaves.count() <= 6 and seen[1][0] <= seen[0][1] * 8 and seen[2][0] <= seen[1][1] * 8
