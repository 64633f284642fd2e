"""op13 against a plain Merkle tree: nulls, ties, repeated rows, several heights, empty tables."""

import random
import zlib
from hashlib import sha256

import pytest

from ladderwork.llm import manifest
from ladderwork.llm.manifest import ManifestParams
from tests.compare import assert_same

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, tree string, pos string, part string"


def rows():
    rng = random.Random(3)
    out = [(i, rng.choice(["a", "b", None]), rng.choice(["en", "de", "é", None, ""]), i, "text ä " * (i % 5)) for i in range(150)]
    out += [(7, "s", "en", None, "x")] * 40 + [(7, "s", "en", 3, "y"), (7, "s", "en", 3, "z")]
    out += [(None, "s", "en", 1, "n"), (None, None, None, None, None), (14, "s", "only", 5, ""), (-5, "s", "en", -1, "w" * 100_000)]
    return out


def digest(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def path(row, i):
    """Levels from row to its root; i's sibling at each, None where it is alone."""
    steps = []
    while len(row) > 1:
        k = i ^ 1
        steps.append((k < i, row[k]) if k < len(row) else None)
        row, i = [digest(*row[j : j + 2]) for j in range(0, len(row), 2)], i // 2
    return row[0], steps


def brute(table):
    trees = {}
    for r in table:
        trees.setdefault(r[2], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        trees[x].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
    hashed = {x: [leaf(*r) for r in trees[x]] for x in langs}
    subroots = [path(hashed[x], 0)[0] for x in langs]
    out = []
    for k, x in enumerate(langs):
        root, above = path(subroots, k)
        for i, r in enumerate(trees[x]):
            steps = path(hashed[x], i)[1] + above
            now, own = hashed[x][i], hashed[x][i]
            if r[0] is not None and r[3] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                now = leaf(r[0], r[1], r[2], r[3] + 1, r[4])
            for s in steps:
                now = digest(now) if s is None else digest(s[1], now) if s[0] else digest(now, s[1])
            proof = digest(*(s[1] for s in steps if s))
            out.append((str(r[0]), own, subroots[k], root, proof, now, now == root))
    return sorted(out)


def shown(df):
    return sorted((str(r.doc_id), r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in df.collect())


@pytest.mark.parametrize("height", [10, 3, 1])
def test_manifest_equals_a_plain_tree(spark, height):
    table = rows()
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in table], SCHEMA).repartition(5)
    assert shown(manifest.manifest(docs, ManifestParams(height=height))) == brute(table)


def test_manifest_of_few_rows(spark):
    for table in ([(1, None, None, None, None)], [(1, "a", "en", 1, "x"), (2, "a", "en", 1, "x")]):
        docs = spark.createDataFrame([(*r, "x", "y", "z") for r in table], SCHEMA)
        assert shown(manifest.manifest(docs)) == brute(table)
    assert manifest.manifest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_manifest_of_equal_rows(spark):
    table = [(5, "a", "en", 1, "x")] * 5000
    docs = spark.createDataFrame([(*r, "x", "y", "z") for r in table], SCHEMA).repartition(4)
    found = manifest.placed(manifest.leaves(docs, ManifestParams()), ["lang"], ["id", "digest"], "equal")
    assert sorted(r.pos for r in found.select("pos").collect()) == list(range(5000))
    assert shown(manifest.manifest(docs, ManifestParams(height=6))) == brute(table)


def test_manifest_in_sql(spark, sf):
    assert_same(manifest.manifest(spark.read.parquet(f"{sf}/documents.parquet"), ManifestParams(height=4)), manifest.ORACLE_SQL, sf)
