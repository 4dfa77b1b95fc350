"""Toxicity, near duplicates, repeated passages, contamination, against brute force and on odd input."""

import random
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from gistline.llm import decontam, simhash, suffix, toxicity, words

from .conftest import prose


def same_rows(a, b):
    return sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


# simhash


def test_code_covers_with_radius_one_and_finds_all_close_blocks():
    x = np.arange(1 << 15)
    assert (np.bitwise_count(x ^ simhash.HOME) <= 1).all()
    assert len(set(simhash.HOME.tolist())) == 1 << 11
    r = random.Random(1)
    for _ in range(300):
        a = r.randrange(1 << 15)
        b = a ^ (1 << r.randrange(15))
        near = {b ^ m for m in simhash.NEAR[simhash.SYNDROME[b]].tolist() if m >= 0}
        assert int(simhash.HOME[a]) in near
        assert all(bin(b ^ n).count("1") <= 2 for n in near)


def test_pairs_against_brute_force(spark):
    r = random.Random(5)
    prints = []
    for i in range(150):
        a = r.getrandbits(128)
        prints.append((2 * i, a))
        flips = r.sample(range(120), r.randrange(1, 30))
        prints.append((2 * i + 1, a ^ sum(1 << f for f in flips)))
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(k, signed(v & (1 << 64) - 1), signed(v >> 64)) for k, v in prints], "key long, a long, b long")
    got = {(p.x, p.y) for p in simhash.near_pairs(df).collect()}
    brute = {(k, m): bin(v ^ w).count("1") for i, (k, v) in enumerate(prints) for m, w in prints[i + 1 :]}
    want = {p for p, d in brute.items() if d <= simhash.THRESHOLD}
    assert got <= want
    assert {p for p, d in brute.items() if d <= 15} <= got
    assert len(got) >= 0.9 * len(want)


def test_components(spark):
    pairs = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 103), (101, 103)], "x long, y long")
    got = {r.node: r.root for r in simhash.components(spark, pairs).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 103: 100}


def test_near_duplicates(docs):
    base = prose(200, 11)
    near = base.split()
    near[50] = near[120] = "other"
    texts = [prose(200, 12), base, " ".join(near), base, prose(200, 13)]
    d = docs(texts)
    assert {tuple(r) for r in simhash.near_duplicates(d).collect()} == {(2, 1), (3, 1)}
    kept = simhash.drop_near_duplicates(d)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {0, 1, 4}


def test_fingerprints_against_plain_loops():
    texts = [prose(60, 1), "a", "the cat the cat sat", None, "", "ÉTÉ été", prose(3000, 2)]
    f, n = simhash.fingerprints(pa.array(texts))
    for k, t in enumerate(texts):
        own = sorted({h >> 20 for h in words.words_of(pa.array([t or ""])).hash.tolist()})
        assert n[k] == len(own)
        for half, salt in enumerate((lambda v: v + (0x51ED270B << 30) & (1 << 64) - 1, lambda v: v ^ 0x7F4A7C15F39CC060)):
            hashes = words.mix(np.array([salt(v) for v in own], np.uint64)).tolist() if own else []
            want = sum((2 * sum(h >> b & 1 for h in hashes) > len(own)) << b for b in range(64))
            assert int(f[k, half]) == want


def test_groups_against_brute_force(docs):
    """Groups of all rows' fingerprints by plain distances; many variants of one text, doc_ids with two texts, equal rows."""
    r = random.Random(4)
    base = [prose(120, 50 + i).split() for i in range(6)]
    texts = []
    for i in range(90):
        w = list(r.choice(base))
        for k in r.sample(range(120), r.randrange(0, 6)):
            w[k] = f"v{r.randrange(50)}"
        texts.append(" ".join(w))
    d = docs(texts).unionByName(docs([texts[0], prose(90, 999), texts[5]], 3))  # doc_ids 3 to 5 have a second text
    rows = [(x.doc_id, x.text, th) for x, th in ((x, x.th_) for x in d.selectExpr("*", "hash(text) th_").collect())]
    f = simhash.fingerprints(pa.array([t for _, t, _ in rows]))[0]
    dist = np.bitwise_count(f[:, None, 0] ^ f[None, :, 0]).astype(int) + np.bitwise_count(f[:, None, 1] ^ f[None, :, 1])
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if dist[i, j] <= 15:  # all of these are found
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    least = {}
    for k, (i, _, th) in enumerate(rows):
        least[label[k]] = min(least.get(label[k], (i, th)), (i, th))
    got = {(g.key, g.th): (g.kept.key, g.kept.th) for g in simhash.groups(d).collect()}
    far = sum(got[i, th] != least[label[k]] for k, (i, _, th) in enumerate(rows))
    assert set(got) == {(i, th) for i, _, th in rows} and far == 0 or ((dist > 15) & (dist <= 20)).any()
    kept = {(x.doc_id, x.text) for x in simhash.drop_near_duplicates(d).collect()}
    assert kept == {(i, t) for i, t, th in rows if got[i, th] == (i, th)} and (4, prose(90, 999)) in kept


def test_links_connect_as_all_pairs_do(spark):
    r = random.Random(6)
    centre = r.getrandbits(128)
    prints = [(i, centre ^ sum(1 << f for f in r.sample(range(120), r.randrange(8)))) for i in range(300)]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(k, signed(v & (1 << 64) - 1), signed(v >> 64)) for k, v in prints], "key long, a long, b long")
    pairs, links = simhash.near_pairs(df), simhash.near_pairs(df, all_pairs=False)
    assert links.count() < pairs.count() / 3
    by = lambda p: {x.node: x.root for x in simhash.components(spark, p).collect()}
    assert by(links) == by(pairs)


def test_anchor_against_all_pairs():
    """Leaders and followers, in batches of any size, connect what all pairs connect; a group of copies is hardly compared."""
    r = np.random.default_rng(8)
    bits = lambda n: r.integers(0, 2, (n, 128), dtype=np.uint8)
    for trial in range(30):
        centres = bits(int(r.integers(1, 6)))
        f = centres[r.integers(0, len(centres), 600)]
        f ^= (r.random(f.shape) < r.choice([0.02, 0.06, 0.1])).astype(np.uint8)
        f = np.unique(f, axis=0)[r.permutation(len(np.unique(f, axis=0)))]
        a, b = np.packbits(f, axis=1, bitorder="little").view(np.uint64).T.copy()
        home, key = np.arange(len(f)) < int(r.integers(0, len(f) + 1)), r.permutation(len(f)) * 7
        d = (f[:, None] != f[None]).sum(axis=2)
        near = np.argwhere((d <= 20) & home[:, None] & ~np.eye(len(f), dtype=bool))
        got = {}
        for all_pairs in (True, False):
            anchor, found, size = simhash._Anchor(20, all_pairs), [], int(r.integers(1, 300))
            for i in range(0, len(f), size):
                s = slice(i, i + size)
                found += [np.stack(x, 1) for x in anchor.add(home[s], key[s], a[s], b[s])]
            got[all_pairs] = {tuple(sorted(x)) for x in np.concatenate(found or [np.zeros((0, 2), int)]).tolist()}
        want = {tuple(sorted((int(key[i]), int(key[j])))) for i, j in near}
        assert got[True] == want

        def groups(links):
            root = {}
            find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
            for x, y in links:
                root[find(x)] = find(y)
            out = {}
            for x in root:
                out.setdefault(find(x), set()).add(x)
            return sorted(map(sorted, out.values()))

        assert groups(got[False]) == groups(want)
    import time

    f = bits(1)[np.zeros(60_000, int)] ^ (r.random((60_000, 128)) < 0.04).astype(np.uint8)
    a, b = np.packbits(f, axis=1, bitorder="little").view(np.uint64).T.copy()
    anchor, began, n = simhash._Anchor(20, False), time.time(), 0
    for i in range(0, 60_000, 4096):
        s = slice(i, i + 4096)
        n += sum(len(x[0]) for x in anchor.add(np.ones(len(a[s]), bool), np.arange(60_000)[s], a[s], b[s]))
    assert n == len({int(x) for x in np.arange(60_000)}) - len(set(anchor.root.tolist())) and time.time() - began < 30


def test_every_near_pair_is_found(spark):
    """Pairs of 16 to 20 bits, spread over all blocks of any kind as evenly as can be, or anyhow; none over 20."""
    r = random.Random(15)
    prints = []
    for i in range(600):
        a, n = r.getrandbits(128), r.randrange(14, 24)
        apart = r.sample(range(128), n) if i % 3 else [(128 * k // n + i) % 128 for k in range(n)]
        prints += [(2 * i, a), (2 * i + 1, a ^ sum(1 << f for f in apart))]
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(k, signed(v & (1 << 64) - 1), signed(v >> 64)) for k, v in prints], "key long, a long, b long")
    want = {(k, m) for i, (k, v) in enumerate(prints) for m, w in prints[i + 1 :] if (v ^ w).bit_count() <= 20}
    assert {tuple(p) for p in simhash.near_pairs(df).collect()} == want
    assert {tuple(p) for p in simhash.near_pairs(df, 7).collect()} == set()
    assert {tuple(p) for p in simhash.near_pairs(df, 23).collect()} == {(2 * i, 2 * i + 1) for i in range(600)}


def test_radii():
    assert sum(simhash.WIDTHS) == 128
    for t in range(60):
        assert sum(r + 1 for r in simhash.radii(t)) == t + 1 and max(simhash.radii(t)) <= min(simhash.WIDTHS)


def test_cells_against_all_pairs():
    """A block's places, in batches of any size, give its pairs, and links that connect them: by cells, crowded ones too, and all compared."""
    r = np.random.default_rng(9)
    for trial in range(18):
        k, top, few = int(r.integers(0, 6)), int(r.integers(1, 6)), [0, None][trial % 2]
        at, width, radius = sum(simhash.WIDTHS[:k]), simhash.WIDTHS[k], simhash.radii(20)[k]
        f = r.integers(0, 2, (int(r.integers(1, 5)), 128), dtype=np.uint8)
        f = f[r.integers(0, len(f), 250)] ^ (r.random((250, 128)) < r.choice([0.02, 0.06, 0.1])).astype(np.uint8)
        if trial % 3 == 0:
            f[:, at : at + width] = f[0, at : at + width]  # one crowded cell
            f[::7, at] ^= 1
        f = np.unique(f, axis=0)
        f = f[r.permutation(len(f))]
        a, b = np.packbits(f, axis=1, bitorder="little").view(np.uint64).T.copy()
        key = r.permutation(len(f)) * 7
        d, by = (f[:, None] != f[None]).sum(axis=2), (f[:, None, at : at + width] != f[None, :, at : at + width]).sum(axis=2)
        least = {tuple(sorted((int(key[i]), int(key[j])))) for i, j in np.argwhere((d <= 20) & (by <= radius)) if i != j}
        most = {tuple(sorted((int(key[i]), int(key[j])))) for i, j in np.argwhere(d <= 20) if i != j}
        rows = next(simhash._cover(20, top)([pa.RecordBatch.from_arrays([pa.array(key), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["key", "a", "b"])]))
        place, flips, key, a, b = (rows.column(c).to_numpy() for c in range(5))
        mine = np.flatnonzero(place >> top == k)
        mine = mine[np.lexsort((flips[mine], place[mine]))]
        got = {}
        for all_pairs in (True, False):
            found, size = [], int(r.integers(20, 300))
            for p in np.unique(place[mine]):
                at_p, cells = mine[place[mine] == p], simhash._Cells(20, all_pairs, k, top, few)
                for i in range(0, len(at_p), size):
                    s = at_p[i : i + size]
                    found += cells.add(flips[s], key[s], a[s].view(np.uint64), b[s].view(np.uint64))
                found += cells.end()
            got[all_pairs] = {tuple(sorted(x)) for x in np.concatenate([np.stack(x, 1) for x in found] or [np.zeros((0, 2), int)]).tolist()}
        assert least <= got[True] <= most
        for links, pairs in ((got[False], least), (most, got[False])):  # links go from root to root
            root = {x: x for x in range(0, 7 * len(f), 7)}
            for x, y in links:
                x, y = root[x], root[y]
                if x != y:
                    root = {z: x if at_z == y else at_z for z, at_z in root.items()}
            assert all(root[x] == root[y] for x, y in pairs)


def test_equal_rows_keep_the_first_by_all_columns(spark):
    d = spark.createDataFrame([(1, "some text here", 3, {"a": 1}), (1, "some text here", 2, {"b": 2}), (2, None, 5, None), (2, None, 4, None)], "doc_id long, text string, place int, `m.ap` map<string,int>")
    assert sorted((x.doc_id, x.place) for x in simhash.drop_near_duplicates(d).collect()) == [(1, 2), (2, 4)]


def test_near_duplicates_odd(odd):
    got = {tuple(r) for r in simhash.near_duplicates(odd).collect()}
    assert got == {(15, 14)}  # the repeated row is one document with its twin
    kept = simhash.drop_near_duplicates(odd).collect()
    assert sorted(r.doc_id or -1 for r in kept) == [-1, 10, 11, 12, 13, 14, 16, 17]
    assert simhash.near_duplicates(odd.limit(0)).count() == 0 and simhash.drop_near_duplicates(odd.limit(0)).count() == 0


# suffix arrays


def test_suffix_array_and_kasai():
    r = np.random.default_rng(3)
    for n, size in ((1, 2), (200, 2), (500, 5)):
        body = r.integers(0, size, n)
        text = np.append(body, size + 5)
        sa, group = suffix.suffix_array(text, 1024)
        want = sorted(range(n + 1), key=lambda i: text[i:].tolist())
        assert sa.tolist() == want
        lcp = suffix.kasai(text, sa, group, 64, 16)
        for k in range(1, n + 1):
            a, b = text[want[k - 1] :].tolist(), text[want[k] :].tolist()
            m = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert lcp[k] == min(m, 64)


def brute_repeats(pairs, least):
    seen, out = {}, set()
    for k, t in sorted(pairs):
        h = words.words_of(pa.array([t])).hash.tolist()
        for i in range(len(h) - least + 1):
            g = tuple(h[i : i + least])
            if g in seen:
                out.add((k, i))
            else:
                seen[g] = (k, i)
    return out


def test_repeats_against_brute_force(docs, monkeypatch):
    r = random.Random(9)
    shared = [prose(n, 100 + n) for n in (50, 51, 90, 300)]
    texts = []
    for i in range(40):
        t = [prose(r.randrange(0, 120), 200 + i)]
        t += [r.choice(shared)] * r.randrange(0, 3) + [prose(r.randrange(1, 60), 300 + i)]
        r.shuffle(t)
        texts.append(". ".join(t))
    texts += ["la " * 400, "la " * 90]
    d = docs(texts).repartition(3)
    monkeypatch.setattr(suffix, "SHARD", 1500)  # in local mode only the driver's plan sees it
    for least in (50, 60):
        got = {(s.doc_id, s.start_word + k) for s in suffix.repeated_passages(d, least).collect() for k in range(s.n_words - least + 1)}
        assert got == brute_repeats(list(enumerate(texts)), least)


def test_hot_minimizer_in_bounded_memory(docs, monkeypatch):
    """One 40-word passage in every document, so that passages meet under few minimizers; little is held at once."""
    r = random.Random(3)
    p, q = prose(45, 1), prose(80, 2)
    texts = [f"{prose(r.randrange(30), i, 10**6)} {p} {prose(20, 900 + i % 40, 10**6)} {q if i % 3 else ''}" for i in range(160)]
    monkeypatch.setattr(suffix, "SHARD", 300)
    monkeypatch.setattr(suffix, "MERGE", 3000)
    got = {(s.doc_id, s.start_word + k) for b in [suffix.repeated_passages(docs(texts).coalesce(1), 50).collect()] for s in b for k in range(s.n_words - 49)}
    assert got == brute_repeats(list(enumerate(texts)), 50)
    rows = [x for b in suffix._shards(50)(pa.RecordBatch.from_arrays([pa.array([i]), pa.array([t]), pa.array([0], pa.int32())], ["key", "text", "th"]) for i, t in enumerate(texts)) for x in [b]]
    t = pa.Table.from_batches(rows).sort_by("key")
    found = {(d, s + k) for b in suffix._merge(50)(t.to_batches(max_chunksize=7)) for d, s, n in zip(*(b.column(c).to_pylist() for c in ("doc", "start", "n"))) for k in range(n)}
    assert found == got


def test_common_words_gather_no_different_passages(docs, monkeypatch):
    """45 words that all documents have, each followed by others: one minimizer for nearly all, unless those are known as common."""
    p = prose(45, 1)
    texts = [f"{prose(40, i, 10**6)} {p} {prose(40, 900 + i, 10**6)}" for i in range(200)] + [f"{p} {prose(30, 900, 10**6)}"] * 3
    d = docs(texts)
    monkeypatch.setattr(suffix, "SAMPLE", 1)
    common = suffix.common_grams(d, 50)
    assert len(common) == 26 and not len(suffix.common_grams(d.limit(10), 50)) and not len(suffix.common_grams(d.limit(0), 50))

    def largest(known):
        """Of the groups of passages by minimizer, the greatest number of different ones."""
        groups = {}
        for i, t in enumerate(texts):
            for b in suffix._shards(50, known)(pa.RecordBatch.from_arrays([pa.array([k]), pa.array([x]), pa.array([0], pa.int32())], ["key", "text", "th"]) for k, x in [(i, t)]):
                for key, blob in zip(b.column("key").to_pylist(), b.column("prints").to_pylist()):
                    groups.setdefault(key, set()).update(blob[j : j + 8] for j in range(0, len(blob or b""), 8))
        return max(map(len, groups.values()))

    assert largest(np.zeros(0, np.uint64)) > 500 and largest(common) < 60
    got = {(s.doc_id, s.start_word + k) for s in suffix.repeated_passages(d).collect() for k in range(s.n_words - 49)}
    assert got == brute_repeats(list(enumerate(texts)), 50)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01/documents.parquet").exists(), reason="no tables")
def test_repeats_of_a_whole_table_against_brute_force(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    got = {(s.doc_id, s.start_word + k) for s in suffix.repeated_passages(d.repartition(5)).collect() for k in range(s.n_words - 49)}
    assert got == brute_repeats([(r.doc_id, r.text or "") for r in d.collect()], 50) and len(got) > 1000


def test_merge_runs():
    r = np.random.default_rng(4)
    keys = r.integers(0, 60, 300).astype(np.uint64)
    shard = r.integers(0, 7, 300)
    runs, winner, first = [], np.arange(300), {}
    for s in range(7):
        at = np.flatnonzero(shard == s)
        k, i = np.unique(keys[at], return_index=True)
        runs.append((k, at[i]))
    kept = np.concatenate([i for _, i in runs])
    suffix.merge_runs(runs, winner)
    while (winner[winner] != winner).any():
        winner = winner[winner]
    for i in sorted(kept):
        assert winner[i] == first.setdefault(int(keys[i]), i)


def test_cut_repeats(docs):
    p = prose(60, 21)
    d = docs([f"Start here, {p}. End.", f"Another {p}! Tail word", p, "short"])
    got = {r.doc_id: r for r in suffix.cut_repeats(d).collect()}
    assert set(got) == {0, 1, 3} and suffix.cut_repeats(d).columns == d.columns
    assert got[1].text == "Another Tail word" and got[1].n_chars == len(got[1].text) and got[1]["a.b"] == 2
    assert got[0].text.startswith("Start here")


def test_repeats_odd(odd):
    got = suffix.repeated_passages(odd).collect()
    assert [(g.doc_id, g.kept_doc_id, g.start_word, g.n_words) for g in got] == [(15, 14, 0, 80)]
    cut = suffix.cut_repeats(odd)
    assert cut.count() == odd.count() - 1
    assert suffix.repeated_passages(odd.limit(0)).count() == 0 and suffix.cut_repeats(odd.limit(0)).count() == 0


# decontamination


def bench(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "item_id long, text string, key string")


def test_contaminated(spark, docs):
    items = [prose(n, 500 + n) for n in (15, 30, 57)] + ["tiny little item", None, ""]
    swapped = items[1].split()
    for k in (6, 14, 23):
        swapped[k] = "swapped"
    texts = [prose(100, 1) + " " + items[0] + " " + prose(50, 2), prose(40, 3) + " " + " ".join(swapped), items[2], prose(300, 4), "a tiny little item here", "tiny item little", " ".join(items[2].split()[20:38])]
    got = {(r.doc_id, r.item_id): (r.start_word, r.n_words, r.n_matched) for r in decontam.contaminated(docs(texts), bench(spark, items)).collect()}
    assert got == {(0, 0): (100, 15, 15), (1, 1): (40, 30, 27), (2, 2): (0, 57, 57), (4, 3): (1, 3, 3), (6, 2): (0, 18, 18)}
    assert sorted(r.doc_id for r in decontam.drop_contaminated(docs(texts), bench(spark, items)).collect()) == [3, 5]
    sliced = decontam.overlaps(docs(texts), bench(spark, items), slice_words=20)
    assert {(r.key, r.item) for r in sliced.collect()} == set(got)


def test_substitutions_against_brute_force(spark, docs):
    r = random.Random(2)
    items = [prose(25, 900 + i) for i in range(20)]
    texts, want = [], set()
    for i, t in enumerate(items * 3):
        w = t.split()
        for k in r.sample(range(25), r.randrange(0, 4)):
            w[k] = f"sub{k}"
        texts.append(prose(30, 1000 + i) + " " + " ".join(w) + " " + prose(30, 2000 + i))
        want.add((i, i % 20))
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(docs(texts), bench(spark, items)).collect()}
    assert got <= want and len(got) >= 0.9 * len(want)


def brute_overlaps(texts, items, least=decontam.LEAST):
    """Every diagonal of every document and item, word by word: the best overlap of those that one of the masks or pieces hits."""
    out = {}
    split = lambda t: words.words_of(pa.array([t])).hash.tolist()
    for i, y in enumerate(map(split, items)):
        n = len(y)
        need = max(int(np.ceil(decontam.ALIKE * n)), min(n, decontam.CERTAIN))
        masks = [[k for k, c in enumerate(m) if c == "1"] + [len(m)] for m in decontam.MASKS]
        if decontam.SHORTEST <= n < min(map(len, decontam.MASKS)):
            masks.append([*range(n), n])
        for d, x in enumerate(map(split, texts)):
            best = None
            for base in range(-n + 1, len(x)):
                same = [0 <= base + k < len(x) and x[base + k] == y[k] for k in range(n)]
                inside = [0 <= base + k < len(x) for k in range(n)]
                total, o = sum(same), None
                if n < decontam.SHORTEST:
                    continue
                seeded = any(all(same[s + k] for k in m[:-1]) and all(inside[s : s + m[-1]]) for m in masks for s in range(n - m[-1] + 1))
                if total >= need and (n > need or seeded):
                    s, e = same.index(True), n - same[::-1].index(True)
                    o = (base + s, e - s, total)
                elif seeded:
                    score, stretch = 0, None
                    for e in range(n):  # the first stretch of greatest score
                        run = 0
                        for s in range(e, -1, -1):
                            if not inside[s] or not inside[e]:
                                break
                            run += 1 if same[s] else -decontam.PENALTY
                            if run > score or (stretch and run == score and e == stretch[1] and s < stretch[0]):
                                score, stretch = run, (s, e)
                    if stretch and sum(same[stretch[0] : stretch[1] + 1]) >= min(least, n):
                        s, e = stretch
                        o = (base + s, e - s + 1, sum(same[s : e + 1]))
                if o and (best is None or (o[2], -o[0]) > (best[2], -best[0])):
                    best = o
            if best:
                out[d, i] = best
    return out


def test_all_diagonals_by_brute_force(spark, docs):
    r = random.Random(12)
    items = [prose(n, 3000 + n, 500) for n in (3, 7, 9, 12, 14, 17, 20, 33, 50)] + ["a b " * 10, "one two", "x " * 15, "1 2 3 " * 6]
    texts = []
    for t in range(60):
        parts = []
        for _ in range(r.randrange(1, 4)):
            w = r.choice(items).split()
            a = r.randrange(0, max(1, len(w) // 3))
            w = w[a : len(w) - r.randrange(0, max(1, len(w) // 3))]
            for k in r.sample(range(len(w)), r.randrange(0, 1 + len(w) // 5)):
                w[k] = "sub"
            parts += [prose(r.randrange(5), 4000 + t), " ".join(w * r.randrange(1, 3))]
        texts.append(" ".join(parts))
    texts += ["a b " * 40, "b " * 30 + "x " * 40, "1 2 3 " * 30, "one two"]
    got = {(x.doc_id, x.item_id): (x.start_word, x.n_words, x.n_matched) for x in decontam.contaminated(docs(texts), bench(spark, items)).collect()}
    assert got == brute_overlaps(texts, items)
    assert [u.item_id for u in decontam.unusable(bench(spark, [*items, "yes", None])).orderBy("item_id").collect()] == [10, 13]


def test_repetitive_texts_take_seconds():
    import time

    began = time.time()
    for unit, n in (("yes ", 100_000), ("0 1 ", 50_000), ("4 8 15 16 ", 25_000)):
        index = decontam.Index([(1, unit * (300 // len(unit.split()))), (2, prose(20, 1))])
        assert index.overlaps(words.words_of(pa.array([unit * n, "other"])), 12) == {(0, 0): (0, 300, 300)}
    assert time.time() - began < 20


def test_short_items_with_substitutions(spark, docs):
    r = random.Random(4)
    items, texts, want = [], [], {}
    for n in (9, 10, 11, 12, 13, 15, 16, 18, 20, 25, 40, 80):
        most = n // 4 if n > 9 else 1
        for k in {0, 1, most // 2, most, most + 1}:
            for _ in range(8):
                w = prose(n, 7000 + len(items), 10**6).split()
                items.append(" ".join(w))
                at = r.sample(range(1, n - 1), k)
                for j in at:
                    w[j] = f"sub{j}"
                if k <= most:
                    want[len(texts), len(texts)] = (30, n, n - k)
                texts.append(" ".join([prose(30, 1), *w, prose(30, 2)]))
    got = {(x.doc_id, x.item_id): (x.start_word, x.n_words, x.n_matched) for x in decontam.contaminated(docs(texts), bench(spark, items)).collect()}
    over = {k: v for k, v in got.items() if k not in want}  # beyond the share only by 12 words of one stretch
    assert {k: v for k, v in got.items() if k in want} == want and all(v[2] >= 12 and k[0] == k[1] for k, v in over.items())
    cut = [" ".join(items[-1].split()[-70:]), "one two three", "", None, " ".join(items[-1].split()[:10])]
    assert [(x.doc_id, x.item_id) for x in decontam.contaminated(docs(cut), bench(spark, items[-1:])).collect()] == [(0, 0)]


def test_contaminated_odd(spark, odd):
    b = bench(spark, [prose(80, 1)])
    assert sorted(r.doc_id for r in decontam.contaminated(odd, b).collect()) == [14, 14, 15]
    assert decontam.contaminated(odd, b.limit(0)).count() == 0 and decontam.contaminated(odd.limit(0), b).count() == 0


# toxicity


def test_isotonic():
    x, y = toxicity.isotonic(np.array([3.0, 1.0, 2.0, 4.0, 2.0]), np.array([0, 0, 1, 1, 0]))
    assert x.tolist() == [1, 2, 3, 4] and np.allclose(y, [0, 1 / 3, 1 / 3, 1])
    assert (np.diff(y) >= 0).all()


def corpus(n, seed):
    r = random.Random(seed)
    texts, y = [], []
    for i in range(n):
        t = prose(r.randrange(30, 200), 5000 + seed * n + i).split()
        bad = i % 4 == 0
        if bad:
            for _ in range(r.randrange(1, 4)):
                t.insert(r.randrange(len(t)), r.choice(["idiot", "you moron", "scum", "id1ot", "st*pid", f"grolb{r.choice('xyzuv')}en"]))
        texts.append(" ".join(t)), y.append(int(bad))
    return texts, y


def test_trees_and_features_against_plain_loops():
    r = random.Random(5)
    x = np.array([[r.randrange(6), r.random(), r.randrange(2)] for _ in range(120)], np.float32)
    y = np.array([int(a > 3 or (b > 0.7 and c)) ^ (r.random() < 0.1) for a, b, c in x.tolist()])
    model = toxicity.fit(x, y, np.arange(120) % 4 == 0, trees=4, depth=2)

    def walk(tree, row):
        feature, threshold, left, right, value = tree
        k = 0
        while feature[k] >= 0:
            k = left[k] if row[feature[k]] <= threshold[k] else right[k]
        return float(value[k])

    margin = [model.base + sum(walk(t, row) for t in model.trees) for row in x]
    assert np.allclose(toxicity.margins(model, x), margin)
    fitted = np.arange(120) % 4 != 0
    fx, fy, at = x[fitted], y[fitted], np.full(90, model.base)
    for tree in model.trees:  # the first split of each is the best of all, by trying every one
        q = 1 / (1 + np.exp(-at))
        g, h = q - fy, q * (1 - q)
        best = 0.0
        for f in range(3):
            edges = np.unique(fx[:, f])[:-1] if len(np.unique(fx[:, f])) <= 32 else np.unique(np.quantile(fx[:, f], np.linspace(0, 1, 33)[1:-1], method="lower"))
            for e in edges:
                s = fx[:, f] <= e
                if 5 <= s.sum() <= 85:
                    best = max(best, g[s].sum() ** 2 / (h[s].sum() + 1) + g[~s].sum() ** 2 / (h[~s].sum() + 1) - g.sum() ** 2 / (h.sum() + 1))
        s = fx[:, tree[0][0]] <= tree[1][0]
        assert best == pytest.approx(g[s].sum() ** 2 / (h[s].sum() + 1) + g[~s].sum() ** 2 / (h[~s].sum() + 1) - g.sum() ** 2 / (h.sum() + 1))
        assert np.allclose([walk(tree, row) for row in fx[:1]], 0.2 * -g[_same_leaf(tree, fx, 0)].sum() / (h[_same_leaf(tree, fx, 0)].sum() + 1))
        at += [walk(tree, row) for row in fx]

    t = "You IDIOT, you are trash!! A SHOUTED Word 2 the idiot"
    got = dict(zip(toxicity.FEATURES, toxicity.features(pa.array([t]))[0].tolist()))
    w = ["you", "idiot", "you", "are", "trash", "a", "shouted", "word", "2", "the", "idiot"]
    hits = [i for i, v in enumerate(w) if v in toxicity.LEXICON]
    want = {"hits": 3, "hit density": 3 / 11, "you": 2 / 11, "near_you": sum(abs(i - j) <= 5 for i in hits for j in (0, 2)), "capitals": sum(c.isupper() for c in t) / len(t), "shouted": 2 / 11, "punctuation": 3 / len(t), "exclaimed": 2 / len(t), "length": np.log1p(11)}
    want["density"] = want.pop("hit density")
    assert all(got[k] == pytest.approx(v, abs=1e-5) for k, v in want.items())
    many = toxicity.features(pa.array(["idiot " * 80]))[0]
    assert many[toxicity.FEATURES.index("hits")] == 80


def _same_leaf(tree, rows, k):
    feature, threshold, left, right, _ = tree

    def leaf(row):
        n = 0
        while feature[n] >= 0:
            n = left[n] if row[feature[n]] <= threshold[n] else right[n]
        return n

    return np.array([leaf(row) == leaf(rows[k]) for row in rows])


def test_very_long_tokens_take_seconds(docs, labels):
    import time

    began = time.time()
    x = toxicity.features(pa.array(["a0a " + "b" * 1_000_000, "a0" * 500_000, "*" * 1_000_000 + "x", "id1ot " * 1000]))
    assert time.time() - began < 20 and x[3, toxicity.FEATURES.index("disguised_hits")] == 1000


def test_held_out_accuracy(docs, labels):
    texts, y = corpus(1200, 3)
    d = docs(texts)
    got = {r.doc_id: r.toxic for r in toxicity.toxicity(d, labels([(i, 1, v) for i, v in enumerate(y) if i < 900])).collect()}
    held = range(900, 1200)
    assert sum(got[i] == bool(y[i]) for i in held) / 300 > 0.95
    assert sum(got[i] and not y[i] for i in held) <= 3


def test_disguises():
    def found(texts):
        return toxicity.features(pa.array(texts))[:, [toxicity.FEATURES.index("disguised"), toxicity.FEATURES.index("disguised_hits")]]

    bad = "id10t f**k b**ch a$$hole $hit @sshole 1diot id1ot st*pid ID10T '1diot' “f**k” $hit! **f**k** !!a$$hole!!".split()
    got = found([f"you {t} there" for t in bad] + bad)
    assert (got[:, 0] > 0).all() and (got[:, 1] == 1).all()
    ends = found(["what a dumba$$", "f*** off", "a dumba$$!!! yes"])
    assert (ends[:, 1] == 1).all()
    assert (found(["idiot!", "*idiot*", "a**b 20th C++", "*hit*", "**", None, "", "$", "20 $ 5"])[:, 1] == 0).all()
    assert (found(["clear", "$hit 1diot", "x", "0", "a", "so i", "d10t"])[:, 1] == [0, 2, 0, 0, 0, 0, 0]).all()
    assert found(["the id", "10t"]).tolist() == [[0, 0], [2, 0]]  # not across documents
    assert found(["1diot" * 100_000, "a+" * 200_000]).tolist()[0][1] == 0


def test_learned_stems():
    w = words.words_of(pa.array(["grolbing the grol GROLBS", None, "x"]))
    rows = np.array([0])
    stems = toxicity.Stems(np.unique(toxicity.beginnings(w, rows, 5)), np.unique(toxicity.beginnings(w, rows, 4)))
    assert toxicity.stem_hits(w, stems).tolist() == [True, False, False, True, False]


def test_toxicity_odd(odd, labels):
    l = labels([(14, 1, 0), (15, None, 1), (14, 1, 1), (None, 1, 1), (16, 1, None)])
    got = toxicity.toxicity(odd, l)
    assert got.count() == odd.count() and got.columns == ["doc_id", "toxicity", "toxic"]
    none = toxicity.toxicity(odd, labels([]))
    assert {r.toxicity for r in none.collect()} == {0.0}
    assert toxicity.drop_toxic(odd, labels([])).columns == odd.columns and same_rows(toxicity.drop_toxic(odd, labels([])), odd)
    assert toxicity.toxicity(odd.limit(0), l).count() == 0
