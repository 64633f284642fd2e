"""Each operator against brute force on small tables with nulls, ties, repeats and extra columns."""

import hashlib
import io
import random
import re
import zlib
from collections import Counter
from math import log10

import numpy as np
import pytest

from ladderwork.llm import decontamination, extraction, fingerprints, hidden_markov, line_dedup, near_duplicates, packing, repeats, toxicity, warc
from ladderwork.llm.common import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, band string, sig string"
RNG = random.Random(7)
VOCABULARY = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 9))) for _ in range(400)]


def prose(n, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice(VOCABULARY) for _ in range(n))


def texts():
    base = prose(120, 1)
    changed = base.split()
    changed[60] = "changed"
    return {
        1: base, 2: base, 3: " ".join(changed), 4: prose(90, 2) + "\n" + prose(40, 3), 5: prose(40, 3) + "\n\n" + prose(30, 4),
        6: None, 7: "", 8: "  \n\t ", 9: "One", 10: "one", 11: "é ß Ünï", 12: prose(3000, 5), 13: prose(100, 6) + " " + base,
    }


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), "x", "y") for i, t in texts().items()]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_components(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (9, 8), (5, 5), (3, 1)], "a long, b long")
    assert {r.id: r.component for r in components(links).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}
    assert components(links.limit(0)).count() == 0


def shingle_sets(width):
    out = {}
    for i, t in texts().items():
        w = words(t)
        out[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    return out


def test_near_duplicates(docs, no_docs):
    sets = shingle_sets(3)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates.near_duplicates(docs, near_duplicates.OP10).collect()}
    assert got == {i: (len(s), root(i), root(i) == i) for i, s in sets.items()}
    assert got[3][1] == 1 and got[10][1] == 9
    assert near_duplicates.near_duplicates(no_docs).count() == 0


def test_near_duplicates_null_and_repeated_ids(spark):
    rows = [(None, "a b c d"), (None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (5, "a b c d")]
    out = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in out) == [
        ("4", "4", True), ("4", "4", True), ("5", "4", False), ("None", "None", True), ("None", "None", True)
    ]


def test_large_bucket_is_finished_exactly(spark):
    """A family whose members are linked through others only: no link may be lost."""
    base = prose(60, 11).split()
    rows, sets = [], []
    for i in range(90):
        w = list(base)
        for k in random.Random(i).sample(range(60), 1 + i % 3):
            w[k] = f"edit{i}"
        rows.append((i, " ".join(w)))
        sets.append({tuple(w[k : k + 3]) for k in range(58)})
    parent = list(range(90))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(90):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    p = near_duplicates.NearDuplicateParams(shingle_words=3, at_least=(85, 100), block=16)
    out = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), p).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: root(i) for i in range(90)}


def test_one_id_with_two_texts_keeps_every_link(spark):
    a, b = prose(60, 21), prose(60, 22)
    rows = [(5, a), (5, b), (9, a + " more"), (11, b + " more"), (12, prose(60, 23)), (9, prose(50, 24)), (13, None), (13, a)]
    out = near_duplicates.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), near_duplicates.OP10).collect()
    assert sorted((r.doc_id, r.n_shingles > 0, r.component_id) for r in out) == [
        (5, True, 5), (5, True, 5), (9, True, 5), (9, True, 5), (11, True, 5), (12, True, 12), (13, False, 13), (13, True, 5)
    ]
    schema = "doc_id long, text string, id string, t long, class string, component string, gone_id long"
    rows += [(12, prose(60, 23)), (None, a), (20, ""), (20, "")]
    docs = spark.createDataFrame([(i, x, "a", 1, "b", "c", 2) for i, x in rows], schema)
    kept = near_duplicates.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = [(5, a), (5, b), (9, rows[5][1]), (12, rows[4][1]), (13, None), (20, ""), (20, ""), (None, a)]
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, want))
    assert near_duplicates.without_near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_of_a_table_equal_brute_force(spark):
    """Components over the whole sf0.01 table against an inverted index over all shingles: recall is 1."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets, postings = {}, {}
    for r in docs.collect():
        w = words(r.text)
        sets[r.doc_id] = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in sorted(sets):
        both = Counter(j for g in sets[i] for j in postings.get(g, ()))
        for j, n in both.items():
            if 100 * n >= 85 * (len(sets[i]) + len(sets[j]) - n):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
        for g in sets[i]:
            postings.setdefault(g, []).append(i)
    out = near_duplicates.near_duplicates(docs, near_duplicates.OP10).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: root(i) for i in sets}
    assert len(set(map(root, sets))) < len(sets)


def test_recall_bounds():
    assert near_duplicates.miss_probability(near_duplicates.OP10) < 1e-6
    assert near_duplicates.miss_probability(near_duplicates.STAGE) < 1e-6


BENCHMARK = "item_id long, text string, words string"


@pytest.mark.parametrize("broadcast", [True, False])
def test_decontamination(spark, docs, no_docs, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(decontamination, "small_enough", lambda *_: False)
        monkeypatch.setattr(decontamination, "maybe_broadcast", lambda df, *_: df)
    t = texts()
    items = [(1, " ".join(t[1].split()[5:40]).upper(), ""), (2, "One", ""), (3, None, ""), (4, "...", ""), (None, t[1], ""), (1, " ".join(t[1].split()[5:40]), ""), (7, " ".join(t[12].split()[-10:]), "")]
    out = {r.doc_id: r for r in decontamination.contamination(docs, spark.createDataFrame(items, BENCHMARK)).collect()}
    assert len(out) == len(t)
    assert [out[i].n_hit for i in (1, 2, 13, 9, 10, 12, 6, 7)] == [35, 35, 35, 1, 1, 10, 0, 0]
    assert out[3].n_hit == 35 and not out[11].contaminated and out[6].n_words == 0
    assert out[1].items_sha256 == hashlib.sha256(b"1").hexdigest()
    assert out[6].n_items == 0 and out[13].n_items == 1 and out[12].n_items == 1
    twice = spark.createDataFrame([(1, t[1]), (1, t[1]), (1, "other"), (None, t[1])], "doc_id long, text string")
    again = decontamination.contamination(twice, spark.createDataFrame(items, BENCHMARK)).collect()
    assert sorted((str(r.doc_id), r.n_hit) for r in again) == [("1", 0), ("1", 35), ("1", 35), ("None", 35)]
    empty = spark.createDataFrame([], BENCHMARK)
    assert not any(r.contaminated for r in decontamination.contamination(docs, empty).collect())
    assert decontamination.contamination(no_docs, empty).count() == 0


def test_line_dedup(docs, no_docs):
    out = {r.doc_id: r for r in line_dedup.deduplicated(docs).collect()}
    t = texts()
    assert out[1].text == t[1] and out[2].text == "" and out[2].n_removed == 1
    assert out[3].text == ""  # one word of 120 changed
    assert out[5].text == "\n" + t[5].split("\n")[2] and out[10].text == "" and out[9].text == "One"
    assert out[6].text is None and out[7].text == "" and out[8].text == t[8] and out[13].text == t[13]
    assert out[12].band == "x" and line_dedup.line_dedup(no_docs).count() == 0


def test_line_dedup_links_every_pair_with_one_letter_changed(spark):
    rng, lines = random.Random(11), []
    for n in list(range(8, 26)) * 4:
        line = prose(n, rng.random())
        at = next(i for i in range(len(line) // 2, len(line)) if line[i] != " ")
        lines += [line, line[:at] + "z" + line[at + 1 :]]
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} for x in lines]
    rows = [(i, x, "en", "s", len(x), "x", "y") for i, x in enumerate(lines)]
    out = {r.doc_id: r.n_removed for r in line_dedup.line_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    near = [5 * len(sets[i] & sets[i + 1]) >= 4 * len(sets[i] | sets[i + 1]) for i in range(0, len(lines), 2)]
    assert sum(near) > 50
    for i, same in enumerate(near):
        assert out[2 * i] == 0 and out[2 * i + 1] == int(same)


def plain_line_dedup(rows, width=5, link=lambda x, y: 5 * len(x & y) >= 4 * len(x | y)):
    """Kept texts by brute force over all pairs of lines that share a shingle, and the pairs that are linked."""
    lines, firsts = {}, {}
    for i, (_, t) in enumerate(rows):
        for k, raw in enumerate((t or "").split("\n")):
            norm = raw.strip(" \t\r\f\v").lower()
            if norm:
                firsts.setdefault(norm, (i, k))
                lines[i, k] = norm
    sets = {x: {x[i : i + width] for i in range(max(1, len(x) - width + 1))} for x in firsts}
    postings, parent, pairs = {}, {x: x for x in firsts}, set()

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for x in sorted(sets, key=firsts.get):
        both = Counter(y for g in sets[x] for y in postings.get(g, ()))
        for y, n in both.items():
            if 5 * n >= 4 * (len(sets[x]) + len(sets[y]) - n):
                pairs.add((y, x))
                a, b = sorted((root(x), root(y)), key=firsts.get)
                parent[b] = a
        for g in sets[x]:
            postings.setdefault(g, []).append(x)
    gone = {place for place, norm in lines.items() if place != firsts[root(norm)]}
    kept = [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, (_, t) in enumerate(rows)]
    return kept, pairs, len(gone)


def test_line_dedup_of_a_table_has_high_recall(spark):
    """Removed lines over the whole sf0.01 table against brute force."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    kept, pairs, gone = plain_line_dedup(rows)
    out = {r.doc_id: r for r in line_dedup.deduplicated(docs).collect()}
    removed = sum(r.n_removed for r in out.values())
    same = sum(out[i].text == k for (i, _), k in zip(rows, kept))
    print(f"linked pairs {len(pairs)}, lines to remove {gone}, removed {removed}, equal documents {same} of {len(rows)}")
    assert 0.99 * gone <= removed <= gone and same >= 0.99 * len(rows)


def test_line_dedup_recall_at_the_threshold(spark):
    """Pairs of lines at 0.80 to 0.84, short and long, apart from all others."""
    rng, rows, near = random.Random(8), [], 0
    for n in [*range(4, 60)] * 4:
        w = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8))) for _ in range(n)]
        line, other = " ".join(w), list(w)
        grams = lambda x: {x[i : i + 5] for i in range(max(1, len(x) - 4))}
        for k in rng.sample(range(n), n):
            tried = [*other[:k], "q" * rng.randint(1, 4), *other[k + 1 :]]
            x, y = grams(line), grams(" ".join(tried))
            if 5 * len(x & y) < 4 * len(x | y):
                break
            other = tried
        if other != w:
            near += 1
            rows += [(len(rows), line), (len(rows) + 1, " ".join(other))]
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found = sum(r.n_removed for r in out)
    print(f"pairs {near}, linked {found}")
    assert near > 150 and 0.95 * near <= found <= near


def test_line_dedup_names_nulls_and_repeated_rows(spark):
    schema = "doc_id long, text string, gone long, text_hash long, n_lines long, n_removed long, line string, row string, `a.b` long"
    long = " ".join(prose(9, i) for i in range(60))
    rows = [(None, "One line of a text here"), (2, "one line of a text here\nother"), (2, "one line of a text here\nother"), (3, None), (4, ""), (5, long + "\n" + long)]
    d = spark.createDataFrame([(i, t, 1, 2, 3, 4, "x", "y", 9) for i, t in rows], schema)
    out = sorted(line_dedup.deduplicated(d).collect(), key=lambda r: (r.doc_id or 0))
    assert [(r.doc_id, r.text, r.n_lines, r.n_removed) for r in out] == [
        (None, rows[0][1], 1, 0), (2, "other", 2, 1), (2, "other", 2, 1), (3, None, 0, 0), (4, "", 1, 0), (5, long, 2, 1)
    ]
    assert {(r.gone, r.text_hash, r.line, r.row, r["a.b"]) for r in out} == {(1, 2, "x", "y", 9)}
    assert line_dedup.deduplicated(d.limit(0)).count() == 0
    assert not [t for t in spark.catalog.listTables() if "line_classes" in t.name]


def test_line_dedup_finishes_buckets_in_blocks(spark):
    """A family whose members are linked through others only, in blocks of two."""
    base, rows = prose(40, 77).split(), []
    for i in range(60):
        w = list(base)
        for k in random.Random(i).sample(range(40), 1 + i % 3):
            w[k] = f"{i}{k}"
        rows.append((i, " ".join(w)))
    _, _, gone = plain_line_dedup(rows)
    out = line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id long, text string"), line_dedup.LineDedupParams(block=2)).collect()
    assert sum(r.n_removed for r in out) == gone


@pytest.fixture(scope="module")
def vocabulary():
    import public_tokenizers
    import tokenizers

    return tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_ids_equal_those_of_tokenizers(vocabulary, sf):
    import pyarrow.parquet as pq

    encode = packing.encoder(packing.default_params().vocabulary)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a1" + " ".join(points[k : k + 500]) + "".join(points[k : k + 500]) for k in range(0, len(points), 500)]
    texts += ["", " ", "\n\n  x\t", "<|endoftext|> hi", "a<|endoftext|><|endoftext|>", "I'll  we've 12345 \u00a0\u2003x", "\U0001f600" * 9]
    texts += [t for t in pq.read_table(f"{sf}/documents.parquet", columns=["text"])["text"].to_pylist() if t]
    for text in texts:
        assert encode(text) == vocabulary.encode(text, add_special_tokens=False).ids, text[:80]


def test_packing(spark, docs, no_docs, vocabulary):
    p = packing.default_params()
    rows = [*texts().items(), (1, "again <|endoftext|> and"), (None, prose(20, 9)), (None, None)]
    out = packing.packed(spark.createDataFrame([(i, t, 5, 6) for i, t in rows], "doc_id long, text string, shard long, length long"), p).toPandas()
    want = []
    for i, text in rows:
        ids = np.array([*vocabulary.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 2048 or 2048
        for k, a in enumerate([0, *range(first, len(ids), 2048)]):
            part = ids[a : a + (first if not k else 2048)]
            want.append((str(i), k, a, len(part), zlib.crc32(part.tobytes())))
    got = [("None" if r.doc_id != r.doc_id else str(int(r.doc_id)), r.piece, r.start, r.length, r.ids_crc32) for r in out.itertuples()]
    assert sorted(got) == sorted(want)
    for _, s in out.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 2048
    assert packing.packed(no_docs, p).count() == 0


def test_fill_is_tight():
    lengths = [RNG.randint(1, 2048) for _ in range(3000)]
    full = packing.fill(lengths, 2048)
    assert Counter(n for b in full for n in b) == Counter(lengths) and max(map(sum, full)) <= 2048
    assert len(full) <= -(-sum(lengths) // 2048) + 40
    assert packing.fill([1024, 1000, 1048, 1024], 2048) == [[1048, 1000], [1024, 1024]]


def test_toxicity_learns_and_holds_out(spark):
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, prose(60, i) + (" vilest " + prose(5, i) if bad else "") + (" vilest garden" if i % 4 == 1 and i < 100 else "")))
        marks.append((i, int(bad)))
    rows += [(1000, None), (1001, ""), (1002, "V1lest " + prose(30, 1)), (1003, "vilеst " + prose(30, 1)), (None, "vilest " + prose(30, 2))]
    marks += [(None, 1), (5, None)]
    d, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.toxicity(d, labels).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(out[i].held_out for i in held)
    assert sum(out[i].predicted == (i % 4 == 0) for i in held) / len(held) > 0.85
    assert out[1000].predicted == 0 and out[1001].score == out[1000].score
    assert out[1002].predicted == 1 and out[1003].predicted == 1
    none = toxicity.toxicity(d, labels.limit(0)).collect()
    assert {r.predicted for r in none} == {0}


def test_fold_of_texts():
    assert toxicity.fold("1D10T, sсum!") == " d t s um " or " idiot " in toxicity.fold("1D10T x")
    assert toxicity.fold(None) == " " and "555" not in toxicity.fold("call 5551234")


def test_fingerprints(docs, no_docs):
    t = texts()
    order = sorted(t, reverse=True)
    out = {r.doc_id: r for r in fingerprints.compared(docs).collect()}
    for k, i in enumerate(order):
        text, after = t[i] or "", t[order[(k + 1) % len(order)]] or ""
        cut = len(text) // 3
        assert out[i].n_chars == len(text)
        assert out[i].edited_sha256 == hashlib.sha256((text[: len(text) - cut] + after[:cut]).encode()).hexdigest()
    assert out[1].fingerprint == out[2].fingerprint and out[2].near_next == 1.0
    assert out[12].near_edited > 0.3 > out[12].near_next
    assert fingerprints.compared(no_docs).count() == 0


def test_fingerprints_of_repeated_and_null_ids(spark):
    base = prose(300, 31)
    rows = [(1, base), (1, base), (1, prose(50, 32)), (None, base), (None, None), (2, ""), (3, "x"), (4, "aaaa" * 9000), (5, prose(9000, 33))]
    d = spark.createDataFrame([(i, t, 1, 2, "z") for i, t in rows], "doc_id long, text string, bucket long, k1 long, fingerprint string").repartition(3)
    out = fingerprints.compared(d).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in out) == sorted((str(i), len(t or "")) for i, t in rows)
    same = {r.fingerprint for r in out if r.n_chars == len(base)}
    assert len(same) == 1
    # each row is followed by the next in order, so the edited digests are those of one ring of rows
    ring = sorted(out, key=lambda r: -(r.doc_id if r.doc_id is not None else -(2**63)))
    texts_of = {}
    for i, t in rows:
        texts_of.setdefault(i, []).append(t or "")
    for r, after in zip(ring, [*ring[1:], ring[0]]):
        digests = {
            hashlib.sha256((t[: len(t) - len(t) // 3] + u[: len(t) // 3]).encode()).hexdigest()
            for t in texts_of[r.doc_id] for u in texts_of[after.doc_id] + texts_of[r.doc_id]
        }
        assert r.edited_sha256 in digests
    alone = fingerprints.compared(d.where("doc_id = 5")).collect()
    assert [r.near_next for r in alone] == [1.0]


def test_likeness_follows_the_shared_share():
    base, other = prose(400, 41), prose(400, 42)
    prints = fingerprints.fingerprint([base, base[: len(base) // 2] + other[len(other) // 2 :], other, "pad " + base, base + base])
    near = [fingerprints.likeness(prints[0], x) for x in prints]
    assert near[0] == 1 and 0.15 < near[1] < 0.6 and near[2] < 0.1 and near[3] > 0.85 and near[4] > 0.85
    assert fingerprints.fingerprint(["", "x", "xx", "ab"])[1:] == fingerprints.fingerprint(["x", "xx", "ab"])


def test_parsing_is_locally_consistent():
    a, b = prose(200, 1), prose(200, 2)
    names = []
    for text in (a, b + a, "x" * 1000 + a):
        s = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        owner, span = np.zeros(len(s), dtype=np.int64), np.ones(len(s), dtype=np.int64)
        for _ in range(2):
            s, owner, span = fingerprints.parse(s, owner, span)
        assert span.sum() == len(text)
        names.append(set(s.tolist()))
        while len(s) > 1:
            before = len(s)
            s, owner, span = fingerprints.parse(s, owner, span)
            assert len(s) < before
    assert len(names[0] & names[1]) > 0.9 * len(names[0]) and len(names[0] & names[2]) > 0.9 * len(names[0])


def test_repeats_of_an_empty_table(docs, no_docs):
    assert repeats.without_repeats(no_docs).count() == 0


def test_merged_runs_know_their_prefixes():
    rng = random.Random(3)
    own = np.zeros(1, dtype=repeats._OWNER)
    runs = [sorted("".join(rng.choice("ab") for _ in range(rng.randint(8, 20))).encode() for _ in range(30)) for _ in range(5)]
    merged = list(repeats.merge_runs([repeats.decode_run(repeats.encode_run([(k, b"", own) for k in r])) for r in runs]))
    assert [m[1] for m in merged] == sorted(k for r in runs for k in r)
    assert all(b[0] == repeats.common_prefix(a[1], b[1]) for a, b in zip(merged, merged[1:]))


def test_hidden_markov(docs, no_docs):
    tokens = {i: [*words(x), None] for i, x in texts().items()}
    train = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(train.values()), len(train)
    out = {r.doc_id: r for r in hidden_markov.scores(docs).collect()}
    for i, ws in tokens.items():
        r = out[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(train[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(log10((train[w] + 1) / (n + v + 1)) for w in ws))
        assert np.isfinite(r.score) and r.score < 0
    assert out[9].score == out[10].score
    assert hidden_markov.scores(no_docs).count() == 0


def test_forward_and_backward_agree_with_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    p = hidden_markov.HiddenMarkovParams(states=2, stretch=2)
    norm = lambda x: x / x.sum(axis=-1, keepdims=True)
    m = hidden_markov.Model(np.zeros(0, np.uint64), norm(rng.random(2)), norm(rng.random((2, 2))), norm(rng.random((2, 4))), np.zeros(3), 0.0)
    seq, at = np.array([0, 2, 1, 3, 2]), np.array([0, 3, 5])
    for k, s in enumerate((seq[:3], seq[3:])):
        total, first = 0.0, np.zeros(2)
        for z in itertools.product(range(2), repeat=len(s)):
            pr = m.start[z[0]] * m.emit[z[0], s[0]]
            for a, b, c in zip(z, z[1:], s[1:]):
                pr *= m.move[a, b] * m.emit[b, c]
            total += pr
            first[z[0]] += pr
        assert hidden_markov._forward(seq, at, m)[k] == pytest.approx(log10(total))
    starts, moves, outs = hidden_markov._expected(seq, at, m, p)
    assert starts.sum() == pytest.approx(2) and moves.sum() == pytest.approx(3) and outs.sum() == pytest.approx(5)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a = "</p><p>x";</script></head><body>
<header class="site-header"><p>Site name and a long enough line of a header, with stops.</p></header><nav><ul><li><a href="/">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice"><p>We use cookies for everything that you can think of here.</p></div>
<article><h1>A &amp; B</h1><p>First   paragraph of the article,\nwith <b>bold</b> words&nbsp;and more of them.</p><p>Short.</p><div class="ad">Buy this now, it is cheap and good!</div>
<p>Second paragraph &lt;of&gt; the article that goes on for a while.</article>
<aside><p>Related things that nobody needs to read in this place at all.</p></aside>
<section class="comments"><p>I do not agree with the article, says a reader at length here.</p></section>
<form><label>Your name please</label></form><footer>&copy; someone &middot; all rights reserved in every place.</footer></body></html>"""


def test_extraction(spark):
    want = "A & B\nFirst paragraph of the article, with bold words and more of them.\nShort.\nSecond paragraph <of> the article that goes on for a while."
    assert extraction.main_text(PAGE) == want
    rows = [(1, "u", PAGE, 3), (2, None, None, 3), (3, "u", "", 3), (None, "u", "<p></p>", 3), (5, "u", "<div><p>Only text, and enough of it to count.", 3)]
    out = extraction.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text long")).collect()
    assert [r.text for r in out] == [want, "", "", "", "Only text, and enough of it to count."] and out[0].n_chars == len(want)
    assert extraction.extracted(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


TEXT = "Some text of the article, with enough words to count here."


@pytest.mark.parametrize(
    "html, want",
    [
        (f'<body class="single right-sidebar"><article><h1>A title of it</h1><p>{TEXT}</article></body>', "A title of it\n" + TEXT),
        (f'<div class="comments-enabled"><div id="content"><p>{TEXT}</p></div></div>', TEXT),
        (f'<article><header class="entry-header"><h1>A title</h1></header><p>{TEXT}</article>', "A title\n" + TEXT),
        (f"<article><p title=it's>{TEXT}</p><p>More.</p></article>", TEXT + "\nMore."),
        (f'<div class="layout-sidebar"><form id=f><main><p>{TEXT}</main></form></div><footer><p>{TEXT}</footer>', TEXT),
        (f'<article><p>{TEXT}</article><section class="comments"><article class="comment"><p>{TEXT}</article></section>', TEXT),
        (f'<main><p>{TEXT}<a title="x > y" href=/a>link</a>&hellip;</main><!-- open', TEXT + "link\u2026"),
        (f"<main><p>{TEXT}</main><p a=b=c=d" + "=e" * 500, TEXT),
    ],
)
def test_hints_of_names_are_bounded(html, want):
    assert extraction.main_text(html) == want


def test_extraction_of_long_and_deep_pages():
    deep = "<div>" * 20_000 + f"<p>{TEXT}</p>" + "</b>" * 20_000 + "</div>" * 20_000
    assert extraction.main_text(deep) == TEXT
    long = "<main>" + f"<p>{TEXT}</p>" * 20_000 + "</main>"
    assert extraction.main_text(long) == "\n".join([TEXT] * 20_000)


def test_extraction_of_the_pages_table():
    """The article's paragraphs and no menu, advert, notice, comment or footer, by the pages' own markup."""
    import pyarrow.parquet as pq

    table = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    right = sum(extraction.main_text(p["html"]).split() == marked_article(p["html"]).split() for p in table)
    assert right >= 0.97 * len(table)


def marked_article(html):
    """Text inside <article> and outside nested furniture, by the standard library's parser."""
    from html.parser import HTMLParser

    skip = {"nav", "footer", "aside", "script", "style", "form", "header"}

    class Reader(HTMLParser):
        void = {"br", "img", "hr", "meta", "link", "input"}

        def __init__(self):
            super().__init__()
            self.open, self.words = [], []

        def handle_starttag(self, tag, attrs):
            if tag in self.void:
                self.words.append(" ")
                return
            names = set(re.split(r"[-_ ]", " ".join(v or "" for k, v in attrs if k in ("class", "id"))))
            self.open.append((tag, tag in skip or bool(names & {"ad", "ads", "cookie", "comments", "comment", "sidebar", "newsletter", "share", "related", "promo", "notice"})))
            if tag in extraction.BLOCKS:
                self.words.append(" ")

        def handle_endtag(self, tag):
            if any(t == tag for t, _ in self.open):
                while self.open.pop()[0] != tag:
                    pass
            if tag in extraction.BLOCKS:
                self.words.append(" ")

        def handle_data(self, data):
            if any(t == "article" for t, _ in self.open) and not any(s for _, s in self.open):
                self.words.append(data)

    reader = Reader()
    reader.feed(html)
    reader.close()
    return "".join(reader.words)


def test_minimum_cut_is_minimal():
    import itertools

    rng = random.Random(5)
    for _ in range(30):
        n = rng.randint(1, 7)
        scores = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(i, j, rng.uniform(0, 1)) for i in range(n) for j in range(i) if rng.random() < 0.5]

        def cost(keep):
            return sum(-s if k and s < 0 else s if not k and s > 0 else 0 for s, k in zip(scores, keep)) + sum(c for i, j, c in edges if keep[i] != keep[j])

        best = min(cost(k) for k in itertools.product([False, True], repeat=n))
        assert cost(extraction.min_cut(scores, edges)) == pytest.approx(best)


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.example/ü", PAGE, 0), (2, None, None, 0)], "page_id long, url string, html string, block long")
    responses = warc.responses_of_pages(pages)
    rows = warc.derivatives(responses).collect()
    source = {r.record_id: bytes(r.block) for r in responses.collect()}
    assert Counter(r.warc_type for r in rows) == {"metadata": 2, "conversion": 2}
    for r in rows:
        assert r.refers_to in source and r.source_block_digest == warc.digest(source[r.refers_to])
        (head, block), *_ = warc.records(io.BytesIO(r.record.encode()))
        assert head["WARC-Refers-To"] == r.refers_to and head["WARC-Block-Digest"] == r.block_digest == warc.digest(block)
        assert len(block) == r.content_length == int(head["Content-Length"])
    path = str(tmp_path / "wet")
    warc.write_derivatives(warc.derivatives(responses), path, "conversion")
    back = warc.read_records(spark, path).collect()
    assert {r.record_id: warc.digest(bytes(r.block)) for r in back} == {r.record_id: r.block_digest for r in rows if r.warc_type == "conversion"}
    assert all(r.whole for r in back)
    odd = warc.derive_one("<urn:x>", None, "d", b"\x00 not http", warc.WarcParams())
    assert [r[1] for r in odd] == ["metadata"]


def http(body, *headers):
    return "\r\n".join(["HTTP/1.1 200 OK", "Content-Type: text/html", *headers, "", ""]).encode() + body


def test_warc_bodies_in_chunks_and_encodings():
    import gzip

    page = b"<meta charset=latin-1><p>caf\xe9</p>"
    chunks = b"5;x=y\r\n" + page[:5] + b"\r\n%x\r\n" % len(page[5:]) + page[5:] + b"\r\n0\r\n\r\n"
    raw = zlib.compressobj(wbits=-15)
    bodies = [
        http(page), http(chunks, "Transfer-Encoding: chunked"), http(page, "Transfer-Encoding: chunked"), http(gzip.compress(page), "Content-Encoding: gzip"),
        http(zlib.compress(page), "Content-Encoding: deflate"), http(raw.compress(page) + raw.flush(), "Content-Encoding: deflate"),
        http(gzip.compress(zlib.compress(page)), "Content-Encoding: deflate, gzip"),
    ]
    for body in bodies:
        rows = warc.derive_one("<urn:x>", None, "d", body, warc.WarcParams())
        assert [r[1] for r in rows] == ["metadata", "conversion"] and rows[1][-1].endswith("caf\u00e9")
    for coding in ("br", "gzip"):  # cannot be undone: metadata only
        assert [r[1] for r in warc.derive_one("<urn:x>", None, "d", http(b"\x8b\x01", f"Content-Encoding: {coding}"), warc.WarcParams())] == ["metadata"]


def test_warc_files_are_read_whole(spark, tmp_path):
    import gzip

    block = b"a\r\n\r\nWARC/1.0\r\nb: c\r\n\r\n\x00\xff end"  # a block that holds the start of a record
    made = [warc.record("resource", {"WARC-Record-ID": f"<urn:{i}>"}, block * i) + b"\r\n\r\n" for i in range(4)]
    (tmp_path / "x").mkdir()
    (tmp_path / "x/a.warc").write_bytes(b"".join(made))
    (tmp_path / "x/b.warc.gz").write_bytes(b"".join(map(gzip.compress, made)))
    back = warc.read_records(spark, str(tmp_path / "x")).collect()
    assert sorted((r.record_id, bytes(r.block), r.whole) for r in back) == sorted((f"<urn:{i}>", block * i, True) for i in range(4) for _ in range(2))


def test_warc_query_rows(spark):
    schema = "page_id long, url string, html string, record string, record_id string"
    assert warc.page_derivatives(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, "u", PAGE, "a", "b"), (1, "u", PAGE, "a", "b"), (None, None, None, "a", "b"), (2, "u", "<p>" + "long text " * 200_000, "a", "b")]
    out = warc.page_derivatives(spark.createDataFrame(rows, schema)).collect()
    assert len(out) == 8 and len({r.record_id for r in out}) == 6
    for r in out:
        (head, block), *_ = warc.records(io.BytesIO(r.record.encode()))
        assert head["WARC-Record-ID"] == r.record_id and warc.digest(block) == r.block_digest and r.http_status == 200
        assert hashlib.sha256(r.record.encode()).hexdigest() == r.record_sha256
    text = next(r.record for r in out if r.warc_type == "conversion" and "First paragraph" in r.record)
    assert "with bold words and more of them." in text and "<b>" not in text
