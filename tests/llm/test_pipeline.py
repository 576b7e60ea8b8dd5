"""The stages of the corpus pipeline against brute force."""

import random

import numpy as np

import corpus_pipeline as pipeline
from gridlake.llm import similar, simhash

from . import brute

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def table(spark, rows):
    return spark.createDataFrame([(k, t, "en", "s", None) for k, t in rows], COLUMNS)


def prose(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def changed(rng, words, n):
    out = list(words)
    for i in rng.sample(range(len(words)), n):
        out[i] = f"other{rng.randrange(10**6)}"
    return out


def shingles(text):
    w = brute.lower(text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    a, b = shingles(a), shingles(b)
    return not a | b or len(a & b) / len(a | b) >= 0.8


def survivors(rows):
    """(id, text) of the row of the smallest id of each component; null ids last."""
    left, out = set(range(len(rows))), []
    while left:
        group, queue = set(), [left.pop()]
        while queue:
            q = queue.pop()
            group.add(q)
            near = {i for i in left if alike(rows[i][1], rows[q][1])}
            left -= near
            queue.extend(near)
        out.append(min((rows[i] for i in group), key=lambda r: (r[0] is None, r[0] or 0)))
    return out


def test_near_copies_go(spark):
    rng, rows = random.Random(3), []
    for n, k in [(100, 1)] * 20 + [(300, 6)] * 20 + [(1000, 10)] * 20 + [(100, 4)] * 10 + [(300, 20)] * 10:
        words = prose(rng, n)
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(changed(rng, words, k)))]
    base = prose(rng, 200)  # a group larger than SMALL
    rows += [(len(rows) + i, " ".join(changed(rng, base, i % 4))) for i in range(30)]
    want = sorted(survivors(rows))
    got = sorted((r.doc_id, r.text) for r in pipeline.near_dedup(spark, table(spark, rows), "").collect())
    assert got == want and len(got) < len(rows) - 60


def test_large_keys_are_dealt_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(similar, "SPLIT", 6)
    rng = random.Random(4)
    base = prose(rng, 150)
    rows = [(i, " ".join(changed(rng, base, i % 6))) for i in range(40)]
    got = sorted((r.doc_id, r.text) for r in pipeline.near_dedup(spark, table(spark, rows), "").collect())
    assert got == sorted(survivors(rows))


def test_a_group_of_near_texts_gives_no_pairs(spark, monkeypatch):
    written, cut = [], similar.cut

    def counted(df):
        written.append((out := cut(df)).count())
        return out

    monkeypatch.setattr(similar, "cut", counted)
    rng = random.Random(8)
    base = prose(rng, 150)
    rows = [(i, " ".join(changed(rng, base, 1 + i % 6))) for i in range(300)]  # most are alike, but below 0.8
    got = sorted((r.doc_id, r.text) for r in pipeline.near_dedup(spark, table(spark, rows), "").collect())
    assert got == sorted(survivors(rows)) and 100 < len(got) < 300
    assert max(written) <= similar.FIRST * similar.NEAR**2 * len(rows)  # a row for each key of the first tables


def test_hot_keys_and_many_edges(spark, monkeypatch):
    monkeypatch.setattr(similar, "KEY", 6)
    monkeypatch.setattr(similar, "SPLIT", 8)
    monkeypatch.setattr(similar, "FEW", 0)
    rng, rows = random.Random(9), []
    for n in (30, 2, 2, 12):
        base = prose(rng, 150)
        rows += [(len(rows) + i, " ".join(changed(rng, base, i % 6))) for i in range(n)]
    rows += [(100, ""), (101, None), (102, "a b"), (103, "A  b")]
    got = sorted((r.doc_id, r.text) for r in pipeline.near_dedup(spark, table(spark, rows), "").collect())
    assert got == sorted(survivors(rows))


def test_joined_names_the_smallest_node():
    rng = np.random.default_rng(2)
    for n, m in [(1, 0), (40, 30), (300, 200)]:
        u, v = rng.integers(-n, n, (2, m))
        want = {int(x): int(x) for x in np.concatenate((u, v))}
        for _ in range(len(want)):
            for x, y in zip(u.tolist(), v.tolist(), strict=True):
                want[x] = want[y] = min(want[x], want[y])
        node, root = similar.joined(u, v)
        assert dict(zip(node.tolist(), root.tolist(), strict=True)) == want


def test_band_keys_meet_at_the_least_similarity():
    rng = np.random.default_rng(1)
    met = 0
    for _ in range(2000):
        x = rng.integers(0, 1 << 63, 100).astype(np.uint64)  # 80 shared of 100
        both = np.concatenate([np.sort(x[:90]), np.sort(np.delete(x, np.s_[80:90]))])
        k = similar.band_keys(both, np.array([90, 90]))
        met += (k[0] == k[1]).any()
    assert met == 2000


def test_golay_keys_meet_at_the_least_similarity():
    rng = np.random.default_rng(6)
    for n, lost in [(9, 1), (90, 10), (270, 30)]:  # n - lost shared of n + lost: 0.8
        pairs = [rng.integers(0, 1 << 63, n + lost).astype(np.uint64) for _ in range(300)]
        near, bits = similar.fingerprints(np.concatenate([y for x in pairs for y in (x[:n], x[lost:])]), np.full(600, n))
        k = similar.keys(near)
        assert all(len(np.intersect1d(a, b)) for a, b in zip(k[::2], k[1::2], strict=True))
        assert (np.bitwise_count(bits[::2] ^ bits[1::2]).sum(1) <= similar.FAR).all()
    # the first codeword of a segment is the one that agrees best with the signs and sums of its bits
    h = rng.integers(0, 1 << 63, 50).astype(np.uint64)
    size = np.array([0, 50])
    agree = similar.sums(h, size)[:, : similar.SEGMENTS * 23].reshape(2, -1, 23) @ (simhash.codewords()[None, :] >> np.arange(23)[:, None] & 1)
    assert (similar.fingerprints(h, size)[0][1, :, 0] == np.argmax(2 * agree[1] - similar.sums(h, size)[1, : similar.SEGMENTS * 23].reshape(-1, 23).sum(1)[:, None], axis=1)).all()


def test_different_texts_with_null_or_repeated_ids_stay(spark):
    rng = random.Random(5)
    a, b, c, d, e = (prose(rng, 120) for _ in range(5))
    text = " ".join
    rows = [
        (None, text(a)), (None, text(b)), (7, text(c)), (7, text(d)), (7, text(d)),
        (1, text(changed(rng, c, 1))),  # 7's text c goes, its text d stays
        (None, text(e)), (9, text(e)), (None, text(a)),
    ]
    got = sorted(((r.doc_id, r.text) for r in pipeline.near_dedup(spark, table(spark, rows), "").collect()), key=repr)
    assert got == sorted([(None, text(a)), (None, text(b)), (7, text(d)), (1, rows[5][1]), (9, text(e))], key=repr)
    assert got == sorted(survivors(rows), key=repr)


SF = "/root/testdata/sf0.001"


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_language_id_rejects_what_cannot_be_told(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = table(spark, [(-1, None), (-2, ""), (-3, "12 34 !"), (-4, "ʘǂǁ ǃʘǀ " * 60)])
    got = pipeline.language_id(spark, docs.unionByName(odd), SF)
    assert got.columns == pipeline.COLUMNS
    kept = texts(got)
    assert not {-1, -2, -3, -4} & set(kept)
    lettered = {k: t for k, t in texts(docs).items() if any(c.isalpha() for c in t or "")}
    assert kept.items() <= lettered.items() and all(k in kept for k, t in lettered.items() if len(t) < pipeline.ENOUGH)


def test_decontaminate_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    passage = next(t for t in items.values() if len((t or "").split()) >= 12)
    whole = table(spark, [(-1, passage), (-2, "before it " + passage + " after it")])
    docs = docs.unionByName(whole)
    before, after = texts(docs), texts(pipeline.decontaminate(spark, docs, SF))
    found = brute.contamination(before, items)
    for k, (words, hit, *_, contaminated) in found.items():
        if contaminated and hit == words:
            assert k not in after
        else:
            assert contaminated != (after[k] == before[k])
    assert -1 not in after and after[-2].split()[:2] == ["before", "it"] and found[-2][4]
    assert not any(x[4] for x in brute.contamination(after, items).values())


def test_redaction_leaves_no_base_finding(spark):
    rows = [(1, "write to ann.lee@example.org or call +1 (415) 555-0132 now"), (2, "from 10.1.2.3 with 4111 1111 1111 1111"), (3, "nothing here"), (None, "bob@example.org")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").unionByName(table(spark, rows))
    got = pipeline.redact_pii(spark, docs, SF).collect()
    assert len(got) == docs.count() and all(r.n_chars == len(r.text) for r in got if r.text is not None)
    assert not any(brute.personal(r.text) for r in got)
    after = {r.doc_id: r.text for r in got if r.doc_id in (1, None)}
    assert "ann.lee" not in after[1] and "write to" in after[1] and "bob" not in after[None]


def test_run_over_a_small_folder(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = [(None, "the first text without an id " * 3 + "one two three four"), (None, "quite another text that has no id " * 3 + "five six seven")]
    docs.unionByName(table(spark, extra)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{SF}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    d = str(tmp_path)
    told = pipeline.language_id(spark, spark.read.parquet(f"{d}/documents.parquet"), d).cache()
    want = survivors([(r.doc_id, r.text) for r in told.collect()])
    got = sorted(((r.doc_id, r.text) for r in pipeline.near_dedup(spark, told, d).collect()), key=repr)
    assert got == sorted(want, key=repr) and len(got) < told.count()
    out = pipeline.run(spark, d).collect()
    assert all(r.round_trip and r.n_tokens == len(r.ids) for r in out)
    ids = [k for k, _ in want]
    assert sum(r.doc_id is None for r in out) == 2 and {r.doc_id for r in out} <= set(ids) and len(out) <= len(ids)
