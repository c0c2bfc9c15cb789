"""Each training-data operator against brute force, with edge cases, and on an empty table."""

import binascii
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeplane.llm import graph_components, jaccard, langid, media, mixing, pii, quality, suffix_dedup, syncmers, token_counts, word_bpe
from citeplane.llm.common import Scratch
from citeplane.llm.queries import tokenizer_path


def rows_of(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


# 1


def test_syncmers_edited_texts(documents):
    rows = sorted((r["doc_id"], r["text"] or "") for r in documents.collect())
    got = {r["doc_id"]: r for r in syncmers.next_likeness(documents).collect()}
    assert len(got) == len(rows)
    for i, (doc, text) in enumerate(rows):
        after, m = rows[(i + 1) % len(rows)][1], len(text) // 4
        edited = text[: len(text) - m] + after[:m]
        r = got[doc]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["fingerprint"] == syncmers.written(syncmers.anchors(text)) and 0 <= r["near_next"] <= 1
    assert np.mean([r["near_edited"] for r in got.values()]) > 0.5 > 0.2 > np.mean([r["near_next"] for r in got.values()])


def test_syncmers_choice():
    text = "".join(random.Random(2).choice("abcd \U0001f600é") for _ in range(400))
    hashes, places = syncmers.anchors(text, 10**6)
    assert len(hashes) and all(0 <= p <= len(text) - syncmers.K for p in places)
    other = syncmers.anchors("#" * 50 + text, 10**6)
    shared = set(other[0]) & set(hashes)
    assert len(shared) >= len(hashes) - 2  # context-free: only the seam can change
    own, none = (hashes, places), (hashes[:0], places[:0])
    assert syncmers.likeness(own, own) == 1.0 and syncmers.likeness(own, none) == 0.0 and syncmers.likeness(none, none) == 1.0
    big = "".join(random.Random(3).choice("abcdefgh ") for _ in range(20_000))
    full, few = syncmers.anchors(big, 10**6)[0], syncmers.anchors(big)[0]
    assert full[: syncmers.SIZE].tolist() == few.tolist()


def plain_anchors(text):
    """Every closed syncmer of the text with its first position, from the hashes of its characters one by one."""
    mask = (1 << 64) - 1
    base = int(syncmers._B)

    def spread(x):
        return ((x + 1) * 0xD1342543DE82EF95) & mask

    def key(s):
        h = 0
        for c in s:
            x = spread(ord(c))
            h = (h * base + (x ^ (x >> 29))) & mask
        h = (h * 0x7FB5D329728EA185) & mask
        return h ^ (h >> 32)

    inner = [key(text[i : i + syncmers.S]) for i in range(len(text) - syncmers.S + 1)]
    found = {}
    for i in range(len(text) - syncmers.K + 1):
        window = inner[i : i + syncmers.WINDOW]
        if min(window) in (window[0], window[-1]):
            whole = np.array([(window[0] * base + window[-1]) & mask], np.uint64)
            found.setdefault(int(syncmers.mix64(whole)[0]) >> 32, i)
    return sorted(found.items())


def test_syncmers_equal_brute_force():
    rng = random.Random(8)
    for n in (15, 16, 40, 900):
        text = "".join(rng.choice("ab é\U0001f600") for _ in range(n))
        want = plain_anchors(text)
        if want:
            assert list(zip(*(x.tolist() for x in syncmers.anchors(text, 10**6)))) == want


def plain_chain(a, b):
    """Longest common order of shared anchors, by trying all pairs."""
    at = sorted((p, dict(b)[h]) for h, p in a if h in dict(b))
    best = []
    for i, (_, q) in enumerate(at):
        best.append(1 + max((best[j] for j in range(i) if at[j][1] < q), default=0))
    return max(best, default=0)


def test_syncmers_match_by_position():
    rng = random.Random(4)
    say = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    one, two = say(1500), say(1500)
    prints = [syncmers.anchors(t) for t in (one + two, two + one, one + say(40) + two, say(3000))]
    for a in prints:
        for b in prints:
            pairs = [list(zip(x[0].tolist(), x[1].tolist())) for x in (a, b)]
            assert syncmers.matched(a, b) == plain_chain(*pairs)
    straight, swapped, longer, other = (syncmers.likeness(prints[0], x) for x in prints)
    assert straight == 1.0 and longer > 0.9 > 0.75 > swapped > 0.3 and other == 0.0


def test_syncmers_edges(edges, nothing):
    got = syncmers.next_likeness(edges).collect()
    assert len(got) == edges.count()
    assert syncmers.next_likeness(nothing).count() == 0


# 2


def test_mixing_targets():
    assert mixing.targets([("b", 100), ("a", 100), (None, 100)]) == pytest.approx({"a": 200.0, "b": 250 / 3, None: 500 / 3})
    many = mixing.targets([(f"s{i:02d}", 50 + i) for i in range(20)])
    assert sum(many.values()) == pytest.approx(1.5 * sum(50 + i for i in range(20)))


def test_flight_keeps_totals():
    rng = random.Random(5)
    units = [(rng.random(), rng.randrange(1, 400), rng.getrandbits(63)) for _ in range(500)]
    p = [0.0] * 500
    for at, x in mixing.flight(units):
        p[at] = x
    assert sum(1e-9 < x < 1 - 1e-9 for x in p) <= 2
    assert sum(p) == pytest.approx(sum(u[0] for u in units)) and sum(x * u[1] for x, u in zip(p, units)) == pytest.approx(sum(u[0] * u[1] for u in units))


def test_mixing_near_targets(spark):
    """Each source's words come within a fiftieth of its target; and the exchange finds what all exchanges would."""
    got = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    for r in got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r["taken"] - r["target"]) <= 0.02 * r["target"], r
    rng = np.random.Generator(np.random.PCG64(4))
    for _ in range(50):
        size, before = rng.integers(1, 60, 12).astype(float), np.full(12, 0.5)
        p = (rng.random(12) < 0.5).astype(float)
        best = min([abs(((p - before) * size).sum()), *(abs(((p - before) * size).sum() - size[i] + size[j]) for i in range(12) for j in range(12) if p[i] == 1 and p[j] == 0)])
        new = mixing.exchanged(p, before, size)
        assert abs(((new - before) * size).sum()) <= best + 1e-9 and new.sum() == p.sum()


def test_mixing(documents, edges, nothing):
    for block in (mixing.BLOCK, 5):
        got = mixing.mix(documents, block=block)
        per = {r["source"]: r for r in got.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.sum("size").alias("size"), F.max("copies").alias("c")).collect()}
        assert all(abs(r["taken"] - r["target"]) <= r["most"] + 1 and r["c"] <= 2 for r in per.values())
    assert sorted(rows_of(got, "doc_id", "copies")) == sorted(rows_of(mixing.mix(documents, block=5), "doc_id", "copies"))
    sizes = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in edges.collect()}
    got = mixing.mix(edges)
    assert got.count() == edges.count() and all(sizes[d] == n for d, n in rows_of(got, "doc_id", "size"))
    assert mixing.mix(nothing).count() == 0


# 3


def test_quality_separates(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels, ~langid.held_out())
    got = quality.predict(docs, model).join(labels, "doc_id").where(langid.held_out())
    right = got.where((F.col("score") >= 0.5) == (F.col("quality") == 1)).count() / got.count()
    assert right > 0.93


@pytest.mark.parametrize("share", [0.2, 0.5, 0.8])
def test_quality_prior(share):
    """The prior of made-up sets of a known share, without any label 0."""
    rng = np.random.default_rng(5)
    good, bad = (rng.normal(m, 1, (6000, len(quality.NAMES))) for m in (0.8, -0.8))
    n = int(3000 * share)
    unlabelled = np.concatenate([good[:n], bad[: 3000 - n]])
    found = quality.class_prior(good[3000:], unlabelled)
    assert abs(found - share) < 0.06
    assert quality.class_prior(good[3000:][::-1], rng.permutation(unlabelled)) == pytest.approx(found)
    assert quality.class_prior(good[:3], bad) == quality.PRIOR
    model = quality.fit(good[3000:], unlabelled, found)
    assert np.mean(model.score(good[n:3000]) >= 0.5) > 0.93 and np.mean(model.score(bad[3000:]) < 0.5) > 0.93


def test_quality_edges(spark, edges, nothing):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {s for (s,) in rows_of(quality.predict(edges, quality.train(edges, none, F.lit(True))), "score")} == {0.5}
    model = quality.fit(np.random.rand(50, len(quality.NAMES)), np.random.rand(60, len(quality.NAMES)), 0.4)
    got = rows_of(quality.predict(edges, model), "doc_id", "score")
    assert len(got) == edges.count() and all(0 <= s <= 1 for _, s in got)
    assert quality.predict(nothing, model).count() == 0


# 4


def test_media(edges, nothing):
    texts = {r["doc_id"]: r["text"] or "" for r in edges.collect()}
    got = media.digests(media.media_columns(edges)).collect()
    assert len(got) == edges.count()
    for r in got:
        raw = texts[r["doc_id"]].encode()
        load = raw + b" " * ((-len(raw)) % 192 or (0 if raw else 192))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(load), hashlib.sha256(load).hexdigest())
        assert r["tail_crc32"] == binascii.crc32(load[-16:]) and r["media_bytes"] == len(load) + 44
        assert r["media_sha256"] == hashlib.sha256(media.to_wav(load)).hexdigest()
    assert media.media_columns(nothing).count() == 0


def test_peaks_in_blocks(monkeypatch):
    signal = bytes(random.Random(4).randrange(256) for _ in range(192 * 40))
    whole = media.peaks(signal)
    monkeypatch.setattr(media, "BLOCK", 7)
    assert all((a == b).all() for a, b in zip(whole, media.peaks(signal)))


# 5


def brute_spans(rows, size):
    seen, out = set(), {}
    for doc, data in rows:
        cover = bytearray(len(data))
        for i in range(len(data) - size + 1):
            window = data[i : i + size]
            if window in seen:
                cover[i : i + size] = b"\1" * size
            seen.add(window)
        kept = bytes(x for x, c in zip(data, cover) if not c)
        runs = sum(1 for i, c in enumerate(cover) if c and not (i and cover[i - 1]))
        out[doc] = (len(data), sum(cover), runs, hashlib.sha256(kept).hexdigest())
    return out


def suffix_case(spark):
    rng = random.Random(8)
    say = lambda n: "".join(rng.choice("abcdeé ") for _ in range(n))
    shared, line = say(260), say(60)
    texts = [None, "", say(99), say(100), shared, shared, say(40) + shared + say(30), shared[:150] + "#" + shared[150:], "ab" * 200, "x" * 500, say(300) + line + say(90), say(70) + line + say(200), (say(120) + shared[40:200]) * 2]
    texts += [shared[:130] + c + shared[131:] for c in "#$%&"] + [say(50) + line + shared[20:140] for _ in range(8)]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("group", [4096, 2])
def test_suffix_dedup(spark, monkeypatch, group):
    rows = suffix_case(spark)
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digests(suffix_dedup.dedup(df)).collect()}
    assert got == brute_spans([(d, (t or "").encode()) for d, t in rows], suffix_dedup.SIZE)


def test_suffix_collisions(spark):
    """Bytes that agree under polynomial hashes modulo a power of two, alone and inside equal surroundings, are kept."""
    one, two = thue_morse(11)
    rng = random.Random(17)
    say = lambda n: "".join(rng.choice("cdefgh ") for _ in range(n))
    head, tail = say(150), say(150)
    rows = list(enumerate([one, two, head + one + tail, head + two + tail, two + say(40), say(40) + one[:1500]]))
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.digests(suffix_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == brute_spans([(d, t.encode()) for d, t in rows], suffix_dedup.SIZE)


def test_suffix_order():
    rng = np.random.Generator(np.random.PCG64(6))
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    data[1000:1300] = data[2000:2300]
    at = rng.permutation(3800)[:900]
    block = np.sort(rng.integers(0, 6, 900))
    tie = rng.permutation(900)
    order = suffix_dedup.Suffixes(data).sort(at, block, tie)
    want = sorted(range(900), key=lambda i: (block[i], bytes(data[at[i] : at[i] + suffix_dedup.SIZE]), tie[i]))
    assert order.tolist() == want


def test_suffix_edges(edges, nothing):
    got = suffix_dedup.dedup(edges.dropDuplicates(["doc_id"])).collect()
    rows = sorted(((r["doc_id"], (r["text"] or "").encode()) for r in edges.dropDuplicates(["doc_id"]).collect()), key=lambda x: (x[0] is not None, x[0]))
    want = brute_spans(rows, suffix_dedup.SIZE)
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in got} == {d: x[:2] for d, x in want.items()}
    assert suffix_dedup.dedup(edges).count() == edges.count() and suffix_dedup.dedup(nothing).count() == 0


def test_suffix_shared_ids(spark):
    """Rows of equal or null doc_id with different texts are documents of their own, in the order of their texts."""
    rng = random.Random(12)
    say = lambda n: "".join(rng.choice("abcde ") for _ in range(n))
    shared, near = say(240), say(300)
    rows = [(None, "1" + shared + say(90)), (None, "2" + shared + say(400)), (None, "3" + say(300)), (None, "4" + say(20)), (None, None), (7, "5" + shared + say(60)), (7, "6" + say(150) + shared), (7, near[:150] + "#" + near[151:]), (7, near[:150] + "%" + near[151:]), (7, ""), (8, near)]
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0], (r[1] or "").encode()))
    want = brute_spans([(i, (t or "").encode()) for i, (_, t) in enumerate(rows)], suffix_dedup.SIZE)
    mixed = rng.sample(rows, len(rows)) + [rows[-1]]
    got = suffix_dedup.digests(suffix_dedup.dedup(spark.createDataFrame(mixed, "doc_id long, text string").repartition(3))).collect()
    found = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got)
    assert found == sorted((str(rows[i][0]), *want[i]) for i in [*range(len(rows)), len(rows) - 1])
    assert sum(r["n_removed"] for r in got) > 900


# 6

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def valid(kind, m):
    d = [int(c) for c in m if c.isascii() and c.isdigit()]
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    if kind == "card":
        return 16 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 8 <= len(d) <= 15


def base_spans(text):
    return [f"{k}:{m.start()}:{m.end()}" for k, p in BASE.items() for m in re.finditer(p, text) if valid(k, m.group())]


def test_pii_rules(spark):
    rng = random.Random(9)
    bits = ["a.b@c.de", "x@y", "@q.r", "1.2.3.4", "1.2.3.4.5", "999.1.1.1", "4111 1111 1111 1111", "4111-1111 11111111", "+1 (415) 555-0100", "+123", "+1 23 45 67 89", "..", "é", "\U0001f600", " ", "-", "a@b.c+x@y.z", "0000.0001.002.255", "9" * 30, "(", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(9))) for _ in range(400)] + ["1" * 50_000, "a." * 20_000 + "@b.c", "+1 " * 3000, "a@b" + ".c" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(rows_of(df.select("doc_id", pii.written(pii.base_spans(F.col("text"))).alias("s")), "doc_id", "s"))
    for i, t in enumerate(texts):
        assert got[i] == ",".join(base_spans(t)), t[:80]


def test_pii_candidates_of_every_text(spark):
    """No text is passed over that a generator matches, whatever its spelling of an address."""
    rng = random.Random(17)
    bits = ["bob", "@", "(at)", "[at]", " at ", "dot", " dot ", "(dot)", "[dot]", ".", " ", "\n", "mail.example", "12", "255", "+", "(", ")", "-", "[.]", "1234", "é", "\U0001f600", "sk_", "A" * 16, "=", "x" * 70]
    texts = ["mail bob(at)example.com now", "bob [at] example.com", "bob at mail.example", "bob at " + "h" * 64 + " dot " + "i" * 64 + " dot org"]
    texts += ["".join(rng.choice(bits) for _ in range(rng.randrange(3, 16))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(rows_of(df.select("doc_id", F.transform(pii.candidates(F.col("text")), lambda c: F.struct(c["generator"], c["s"], c["e"])).alias("c")), "doc_id", "c"))
    for i, t in enumerate(texts):
        assert [tuple(c) for c in got[i]] == [(g, *m.span()) for g, pattern in enumerate(pii.GENERATORS) for m in re.finditer(pattern, t)], t
    assert all(got[i] for i in range(4))


def test_pii_digests_and_redaction(edges, nothing):
    texts = {r["doc_id"]: r["text"] or "" for r in edges.collect()}
    found = pii.find(edges, ("doc_id", "text"))
    got = pii.digests(found).collect()
    assert len(got) == edges.count()
    for r in got:
        base = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(r["spans"].split(",")) | {""} and r["n_email"] == sum(b.startswith("email") for b in base)
    clean = dict(rows_of(found.select("doc_id", pii.redacted(F.col("text"), F.col("base")).alias("t")), "doc_id", "t"))
    assert clean[15] == "mail [EMAIL] or [PHONE], card [CARD], ip [IP]" and clean[0] is None and clean[1] == ""
    assert pii.find(nothing).count() == 0


def test_pii_trees():
    cells = []
    for nd in range(8):
        for cue in (0, 1):
            for half in (0, 1):
                good = 50 if nd in (4, 5) and cue else 0
                cells.append((1, nd, 2, 0, 0, 1, 1, cue, half, good, 60 - good))
    trees, (a, b), threshold = pii.fit(cells, 0.8, 0.5)
    x = np.array([c[:8] for c in cells], float)
    top = 1 / (1 + np.exp(-(a * trees.margins(x).max() + b)))
    assert abs(top - 50 / 60) < 0.05  # calibrated: the share that is right
    picked = {(int(a[1]), int(a[7])) for a, m in zip(x, np.round(trees.margins(x), 9)) if threshold is not None and m >= threshold}
    assert picked == {(4, 1), (5, 1)}
    assert pii.fit([], 0.9)[2] is None


# 7


def test_langid(documents, edges, nothing):
    model = langid.fit(documents.where(~langid.held_out()))
    got = langid.predict(documents, model, ("doc_id", "lang")).where(langid.held_out()).where("lang IS NOT NULL")
    assert got.where("lang = lang_pred").count() / got.count() > 0.95
    odd = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.predict(edges, model).collect()}
    assert all(odd[i] == ("und", 0.0) for i in (0, 1, 2, 4, 17)) and odd[3][0] != "und"
    assert langid.predict(nothing, model).count() == 0
    assert set(rows_of(langid.predict(edges, langid.fit(nothing)), "lang_pred", "score")) == {("und", 0.0)}


def test_langid_alone_equals_batch():
    model = (["a", "b"], np.log(np.random.Generator(np.random.PCG64(1)).random((langid.BUCKETS, 2)).astype(np.float32)), np.log(np.array([0.5, 0.5])))
    texts = ["hello there", "", "Ünï", "x" * 999, "1 2 3"]
    together = langid.score(texts, *model)
    for i, t in enumerate(texts):
        alone = langid.score([t], *model)
        assert alone[0][0] == together[0][i] and alone[1][0] == pytest.approx(together[1][i], abs=1e-6)


# 8


def brute_components(rows, words, percent):
    sets, root = {}, {}
    for doc, text in rows:
        found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets[doc] = {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()
        root[doc] = doc
    find = lambda x: x if root[x] == x else find(root[x])
    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d)) for d in docs}


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80)])
def test_jaccard(spark, words, percent):
    rng = random.Random(12)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = [(0, None), (1, ""), (2, "a"), (3, "A "), (4, "a b c"), (5, " \n")]
    for group in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 9, 10, 14, 40, 63, 64, 150, 400]))]
        for _ in range(14):
            copy = list(base)
            for _ in range(rng.randrange(0, 2 + len(base) // 18)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(copy[: len(copy) - rng.randrange(0, 2 + len(copy) // 15)])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(df, words, percent).collect()}
    assert got == brute_components(rows, words, percent)


def test_keys_meet():
    """Linked sets always meet in the keys that they keep, however rare the others."""
    rng = random.Random(14)
    for _ in range(300):
        n, percent = rng.randrange(5, 300), rng.choice([80, 90])
        a = sorted(rng.getrandbits(64) for _ in range(n))
        d = rng.randrange(0, jaccard.differences(n, percent) + 1)
        b = sorted(a[: n - d // 2] + [rng.getrandbits(64) for _ in range(d - d // 2)]) if d else a
        x, y = np.array(a, np.uint64), np.array(b, np.uint64)
        if not jaccard.linked(x, y, percent) or not jaccard.differences(len(x), percent) or not jaccard.differences(len(y), percent):
            continue
        kept = []
        low = min(jaccard.band(len(x)), jaccard.band(len(y)))
        for s in (x, y):
            sums = np.append(np.uint64(0), np.cumsum(jaccard.mix64(s)))
            kept.append(jaccard.tile_keys(s, sums, low, percent))
        shared = set(kept[0][1].tolist()) & set(kept[1][1].tolist())
        order = {k: (rng.randrange(1, 5), k) for k in {*kept[0][1].tolist(), *kept[1][1].tolist()}}
        first = []
        for slack, keys in kept:
            common = sorted((k for k in keys.tolist() if k in shared), key=order.get)
            first.append(set(common[: max(0, min(len(common), slack + len(common)))]))
        assert first[0] & first[1]


def thue_morse(n):
    """The two complementary words of length 2^n, which agree under polynomial hashes modulo a power of two."""
    one, two = "a", "b"
    for _ in range(n):
        one, two = one + two, two + one
    return one, two


def test_jaccard_words_apart(spark):
    """Words that simple polynomial hashes confuse stay different, alone, in short texts and in long ones."""
    rng = random.Random(21)
    rows = []
    for n in (10, 11, 12):
        rest = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
        for word in thue_morse(n):
            rows += [word, word + " x", " ".join([word + str(i) for i in range(20)]), rest + " " + word]
    rows += ["b c d", "b c d b c d", "r r r", "r r r r r", "R r R r"]
    rows = list(enumerate(rows))
    for words, percent in ((3, 90), (5, 80)):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), words, percent).collect()}
        assert got == brute_components(rows, words, percent)


@pytest.mark.parametrize("pack, block", [(1 << 21, 1024), (300, 3)])
def test_jaccard_small_portions(spark, monkeypatch, pack, block):
    """One large group of near copies and a passage that many texts share, with keys sent and sets compared in portions."""
    monkeypatch.setattr(jaccard, "PACK", pack)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    rng = random.Random(22)
    say = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    base, passage, rows = say(60), say(50), []
    for _ in range(70):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(len(copy))] = "x" + str(rng.randrange(99))
        rows.append(" ".join(copy))
    rows += [" ".join(say(rng.randrange(5, 40)) + passage + say(rng.randrange(5, 40))) for _ in range(40)]
    rows = list(enumerate(rows))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 5, 80).collect()}
    assert got == brute_components(rows, 5, 80)


def test_jaccard_edges(edges, nothing):
    got = jaccard.join(edges).collect()
    assert len(got) == edges.count()
    assert {r["component_id"] for r in got if r["doc_id"] in (5, 6, 7)} == {5}
    assert jaccard.join(nothing).count() == 0


def test_jaccard_shared_ids(spark):
    """Rows of null or equal doc_id link by their own texts; repeated rows all come back."""
    say = lambda x: " ".join(f"{x}{i}" for i in range(60))
    rows = [(3, say("a")), (3, say("a")), (3, say("b")), (None, say("b")), (None, say("c")), (None, say("c")), (9, say("a") + " end"), (None, None), (4, "")]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(2)).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in got) == sorted([("3", 56, "3")] * 3 + [("None", 56, "3")] + [("None", 56, "None")] * 2 + [("9", 57, "3"), ("None", 0, "None"), ("4", 0, "4")])


def test_components(spark):
    rng = random.Random(15)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "a long, b long")
    root = {x: x for e in edges for x in e}
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = dict(rows_of(graph_components.components(df, Scratch(spark, "t"), "t"), "node", "root"))
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


# 9 and 10


@pytest.fixture(scope="session")
def strange():
    rng = random.Random(16)
    letters = "abcdefghijklmnopqrstuvwxyz éüñß'0123<|>endofx \n\t日本Σİﬁ\U0001f44d!.,▁\x00"
    made = ["".join(rng.choice(letters) for _ in range(rng.randrange(90))) for _ in range(800)]
    return [*made, "", " ", "a<|endoftext|>b <|startoftext|><|endoftext|>", "x" * 3000, "ab" * 2000, "!" * 200, "the" * 40, "I'll it's we've 'dx", " " * 3000, "word  " * 3000, "the \n" * 4000, "\n" * 90]


def test_word_bpe(documents, strange):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    library.no_truncation()
    library.no_padding()
    own = word_bpe.tokenizer(tokenizer_path("word_bpe_49k.json"))
    texts = strange + [r["text"] or "" for r in documents.collect()]
    for text, ids, want in zip(texts, own.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == want.ids, text[:60]
        assert own.decode(ids) == library.decode(want.ids, skip_special_tokens=False)
    assert 0 < own.exact < own.seen


def test_word_bpe_rows(edges, nothing):
    path = tokenizer_path("word_bpe_49k.json")
    got = word_bpe.digests(word_bpe.encode(edges, path)).collect()
    assert len(got) == edges.count()
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r["n_tokens"] == 0 and r["ids_sha256"] == r["decoded_sha256"] == empty for r in got if r["doc_id"] in (0, 1, 2))
    assert word_bpe.encode(nothing, path).count() == 0


def test_token_counts(documents, strange, monkeypatch):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.counter(path)
    texts = strange + [r["text"] or "" for r in documents.collect()]
    want = [len(x) for x in library.encode(texts, num_threads=1)]
    assert own.count(texts) == want
    for chunk in (1, 7, 64):
        monkeypatch.setattr(token_counts, "CHUNK", chunk)
        short = [(t, n) for t, n in zip(texts, want) if len(t) < 400][:500]
        assert [own.total(t) for t, _ in short] == [n for _, n in short]


def test_chunk_maps_are_associative():
    own = token_counts.counter(tokenizer_path("piece_bpe_32k.model"))
    rng = random.Random(17)
    for _ in range(200):
        a, b, c = (own.chunk_map("".join(rng.choice("▁▁xy\n") for _ in range(rng.randrange(1, 9)))) for _ in range(3))
        assert own.compose(own.compose(a, b), c) == own.compose(a, own.compose(b, c))


def test_token_count_rows(edges, nothing):
    path = tokenizer_path("piece_bpe_32k.model")
    got = token_counts.token_counts(edges, path, limit=50).collect()
    assert len(got) == edges.count() and all(r["over_limit"] == (r["n_tokens"] > 50) for r in got)
    assert token_counts.token_counts(nothing, path).count() == 0
