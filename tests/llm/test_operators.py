"""Each operator against brute force, a library, or an exact round trip; nulls, empty tables and odd rows everywhere."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from surefact.llm import bpe, grouping, licences, media, neighbours, ngrams, packing, secrets, simhash, toxicity, warc
from surefact.llm.queries import TOKENIZER

PATH = public_tokenizers.path(TOKENIZER)
ODD = [None, "", " \n", "a", "ÀÉ ß Σς İ", "x" * 20_000, "don't <|endoftext|> we'll", "\x00\x1c 漢字 🙂", "the cat sat", "the cat sat"]


def documents(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_padding(), t.no_truncation()
    rnd = random.Random(1)
    alphabet = "abcdefgstlrevm'’ÀÉßΣςİı Kéñ漢字́0123９ⅷ\t\n\x0b\x1c\x85\xa0%&🙂हिन्दी"
    texts = ODD + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    own = bpe.load(PATH).encode_batch([x or "" for x in texts])
    want = t.encode_batch([x or "" for x in texts], add_special_tokens=False)
    assert [x.tolist() for x in own] == [x.ids for x in want]
    rows = {r.doc_id: r for r in bpe.round_trip(documents(spark, ODD), PATH).collect()}
    for i, x in enumerate(ODD):
        ids = t.encode(x or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.round_trip(documents(spark, []), PATH).count() == 0


def test_neighbours_find_what_brute_force_finds(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(900, 16)).astype(np.float32)
    x[100:160] = x[0]  # copies
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = neighbours.nearest(df, F.col("vec_id") % 100 == 0, 10, shard=300).collect()
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}
    hit = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((np.arange(900), d)) if i != q][:10]
        hit += len(set(best) & {found[q, k][0] for k in range(1, 11)})
        for k in range(1, 11):
            assert abs(found[q, k][1] - d[found[q, k][0]]) < 1e-9
    assert hit >= 85
    assert [found[0, k][0] for k in range(1, 11)] == list(range(100, 110))
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_neighbours_in_many_blocks_and_double_precision(spark, monkeypatch):
    """Several blocks of queries meet several graphs; what single precision cannot tell apart is ranked exactly."""
    monkeypatch.setattr(neighbours, "BLOCK_BYTES", 256)
    x = np.random.default_rng(5).normal(size=(600, 6))
    x[1:12] = x[0] + np.arange(11, 0, -1)[:, None] * 1e-11
    df = spark.createDataFrame([(i, v.tolist(), "extra") for i, v in enumerate(x)], "vec_id long, embedding array<double>, h string")
    got = {}
    for r in neighbours.nearest(df, F.col("vec_id") % 100 == 0, 10, shard=200).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert sorted(got) == list(range(0, 600, 100))
    assert [v for _, v, _ in sorted(got[0])] == list(range(11, 1, -1))
    for q, near in got.items():
        assert all(abs(s - np.sqrt(((x[v] - x[q]) ** 2).sum())) < 1e-15 for _, v, s in near) and len(near) == 10


def test_media_round_trip(spark):
    raw = [media.padded(x) for x in (b"", b"a", bytes(range(256)) * 3, b"ab" * 700_000, random.Random(1).randbytes(5000))]
    files = media.write_samples(raw)
    assert media.read_samples(files) == raw
    for f, p in list(zip(files, raw, strict=True))[:3]:
        assert media.read_general(next(media.streams(f)))[..., 2].tobytes() == p
    docs = documents(spark, ODD)
    rows = {r.doc_id: r for r in media.describe(media.store(docs)).collect()}
    for i, x in enumerate(ODD):
        p = media.padded((x or "").encode())
        assert rows[i].payload_sha256 == hashlib.sha256(p).hexdigest() and rows[i].tail_crc32 == zlib.crc32(p[-64:])


def bits(*parts):
    out = media.Bits()
    for value, n in parts:
        out.put(value, n)
    return out


def stream(width, height, transforms, body):
    out = bits((0x2F, 8), (width - 1, 14), (height - 1, 14), (0, 4))
    for t in transforms:
        out.put(1, 1)
        out.put(t.value, t.n)
    out.put(0, 1)
    out.put(body.value, body.n)
    return out.value.to_bytes(out.n // 8 + 1, "little")


def literal_image(pixels, main):
    """Pixels (ARGB) as literals with flat 8-bit codes."""
    out = bits((0, 1), *([(0, 1)] if main else []))
    flat = [8] * 256
    media.put_code(out, flat + [0] * 24)
    for _ in range(3):
        media.put_code(out, flat)
    media.put_simple(out, 0)
    codes = media.canonical(flat)
    for p in pixels:
        for shift in (8, 16, 0, 24):
            out.put(codes[p >> shift & 255], 8)
    return out


@pytest.mark.parametrize("mode", range(14))
def test_media_inverts_predictors(mode):
    rng = np.random.default_rng(mode)
    want = rng.integers(0, 256, (9, 11, 4))
    rows, residue = [[tuple(int(c) for c in p) for p in row] for row in want], []
    for y in range(9):
        for x in range(11):
            fixed, *near = media.neighbours(rows, x, y, 11)
            guess = media.predict(mode if fixed is None else fixed, *near)
            a, r, g, b = ((int(c) - k) & 255 for c, k in zip(want[y, x], guess, strict=True))
            residue.append(a << 24 | r << 16 | g << 8 | b)
    tiles = literal_image([mode << 8] * 9, False)  # tiles of 4 pixels
    t = bits((0, 2), (0, 3), (tiles.value, tiles.n))
    assert (media.read_general(stream(11, 9, [t], literal_image(residue, True))) == want).all()


def test_media_inverts_colour_transforms_and_palette():
    rng = np.random.default_rng(1)
    want = rng.integers(0, 256, (4, 8, 4))
    s8 = lambda v: (int(v) & 255) - ((int(v) & 128) << 1)
    gr, gb, rb = 40, 200, 17
    stored = []
    for a, r, g, b in want.reshape(-1, 4).tolist():
        r2 = (r - (s8(gr) * s8(g) >> 5)) & 255
        b2 = (b - (s8(gb) * s8(g) >> 5) - (s8(rb) * s8(r) >> 5)) & 255
        stored.append((a, r2, g, b2))
    tile = literal_image([255 << 24 | rb << 16 | gb << 8 | gr] * 2, False)
    cross = bits((1, 2), (0, 3), (tile.value, tile.n))
    got = media.read_general(stream(8, 4, [cross], literal_image([a << 24 | r << 16 | g << 8 | b for a, r, g, b in stored], True)))
    assert (got == want).all()
    green = [(a, (r - g) & 255, g, (b - g) & 255) for a, r, g, b in want.reshape(-1, 4).tolist()]
    got = media.read_general(stream(8, 4, [bits((2, 2))], literal_image([a << 24 | r << 16 | g << 8 | b for a, r, g, b in green], True)))
    assert (got == want).all()
    colours, index = [(255, 1, 2, 3), (255, 9, 9, 9), (0, 7, 200, 5)], rng.integers(0, 3, (3, 10))
    steps, last = [], (0, 0, 0, 0)
    for c in colours:
        a, r, g, b = ((x - y) & 255 for x, y in zip(c, last, strict=True))
        steps.append(a << 24 | r << 16 | g << 8 | b)
        last = c
    table = literal_image(steps, False)
    packed = [sum(int(v) << (2 * k) for k, v in enumerate(row[4 * j : 4 * j + 4])) << 8 for row in index for j in range(3)]
    got = media.read_general(stream(10, 3, [bits((3, 2), (len(colours) - 1, 8), (table.value, table.n))], literal_image(packed, True)))
    assert (got == np.array(colours)[index]).all()


def test_media_writes_back_references_and_palettes():
    """Passages that stand before are shorter than literals, few colours are packed, and both readers agree."""
    line = random.Random(3).randbytes(200)
    raw = [media.padded(x) for x in (line + b"?" * 70 + line, line * 40, b"xyz\n" * 9, b"no " * 999, b"0123456789abcdef" * 8, b"\1" * 640, random.Random(4).randbytes(600) * 2000)]
    files = media.write_samples(raw)
    assert media.read_samples(files) == raw
    assert [media.plain_samples(next(media.streams(f))).palette is not None for f in files] == [False, False, True, True, True, True, False]
    assert len(files[0]) < 400 and len(files[1]) < 400 and len(files[3]) < 200 and len(files[-1]) < 5000
    for f, p in zip(files[:-1], raw[:-1], strict=True):
        image = media.read_general(next(media.streams(f)))
        assert image[..., 2].tobytes() == p and (image[..., 0] == 255).all() and not image[..., [1, 3]].any()
    # A file does not depend on those written with it.
    assert [media.write_samples([p])[0] for p in raw] == files


def test_media_pixels_of_all_channels(spark):
    want = np.random.default_rng(2).integers(0, 256, (3, 5, 4))
    body = stream(5, 3, [], literal_image([a << 24 | r << 16 | g << 8 | b for a, r, g, b in want.reshape(-1, 4).tolist()], True))
    chunk = b"VP8L" + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) & 1)
    file = b"RIFF" + (len(chunk) + 4).to_bytes(4, "little") + b"WEBP" + chunk
    df = spark.createDataFrame([(1, file, 0), (2, None, 0), (3, b"", 0), (4, b"broken", 0), (5, file * 2, 0)], "doc_id long, media binary, width int")
    got = {(r.doc_id, r.image): r for r in media.pixels(df).collect()}
    assert sorted(got) == [(1, 0), (5, 0), (5, 1)]
    assert all((r.width, r.height, bytes(r.argb)) == (5, 3, want.astype(np.uint8).tobytes()) for r in got.values())
    assert media.pixels(df.limit(0)).count() == 0


def test_media_back_references_and_cache():
    """Two literals, a copy of ten from distance 2, then a pixel from the colour cache."""
    out = bits((1, 1), (2, 4), (0, 1))  # cache of 4
    cells = [0x11223344, 0x55667788]
    slots = [(0x1E35A7BD * c & 0xFFFFFFFF) >> 30 for c in cells]
    # Length 10: symbol 256 + 6 with two extra bits (9..12); distance 2: code 122, symbol 13 (97..128 has 5 bits).
    lengths = [0] * 284
    used = [0x33, 0x77, 256 + 6, 280 + slots[1]]
    for s in used:
        lengths[s] = 2
    media.put_code(out, lengths)
    for pair in ((0x22, 0x66), (0x44, 0x88), (0x11, 0x55)):
        own = [0] * 256
        own[pair[0]] = own[pair[1]] = 1
        media.put_code(out, own)
    media.put_simple(out, 13)
    codes = media.canonical(lengths)
    one = {c: k for k, c in enumerate((0x22, 0x66))} | {c: k for k, c in enumerate((0x44, 0x88))} | {c: k for k, c in enumerate((0x11, 0x55))}
    for c in cells:
        out.put(codes[c >> 8 & 255], 2)
        for shift in (16, 0, 24):
            out.put(one[c >> shift & 255], 1)
    out.put(codes[256 + 6], 2)
    out.put(10 - 9, 2)  # symbol 6: values 9 to 12
    out.put(122 - 97, 5)
    out.put(codes[280 + slots[1]], 2)
    got = media.read_general(stream(13, 1, [], out))
    want = (cells * 6)[:12] + [cells[1]]
    assert media.channels(np.array(want, dtype=np.uint32)).tolist() == got[0].tolist()


def test_components_with_hubs(spark):
    """Hubs that are the least, the greatest or a middle node of their stars, paths between them and nodes apart."""
    links = [(5, k) for k in range(100, 160)] + [(9000, k) for k in range(200, 270)] + [(350, k) for k in range(300, 400) if k != 350]
    links += [(159, 200)] + [(k, k + 1) for k in range(500, 515)] + [(7, 7), (8, 6), (6, 8)]
    forest = {}
    root = lambda x: x if forest.setdefault(x, x) == x else root(forest[x])
    for a, b in links:
        p, q = sorted((root(a), root(b)))
        forest[q] = p
    got = {r.node: r.root for r in grouping.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: root(x) for x in forest if x != 7}


def test_licences_find_phrases_everywhere(spark):
    texts = ODD + ["The MIT License. GNU General\nPublic License, apache-license cc by", "Licensed under the Apache License, Version 2.0.", "mit mit license license", licences.NOTICES[5][1].upper()]
    rows = {r.doc_id: r for r in licences.scan(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = licences.words_of(t or "")
        want = sorted((k, label) for phrase, label in licences.PHRASES for p in [phrase.encode().split()] for k in range(len(w)) if w[k : k + len(p)] == p)
        assert rows[i].n_words == len(w) and sorted((p.start, p.label) for p in rows[i].phrases) == want
    assert [s.label for s in rows[len(texts) - 1].spans] == ["bsd"]


def test_licences_tell_each_notice(spark):
    """Every notice in the middle of other words has its own label and no other."""
    texts = [f"some words before it {text} and words behind" for _, text in licences.NOTICES]
    for r in licences.scan(documents(spark, texts)).collect():
        assert {s.label for s in r.spans} <= {licences.NOTICES[r.doc_id][0]} and max((s.cover for s in r.spans), default=0) == 1, r


def test_packing_loses_and_repeats_nothing(spark):
    rnd = random.Random(4)
    texts = ODD + [" ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "omega", "zeta"]) for _ in range(rnd.randint(1, 900))) for _ in range(120)] + ["alpha beta " * 6000]
    got = packing.pack(documents(spark, texts).coalesce(1), PATH).collect()
    ids = [np.append(x, 1).astype("<u4") for x in bpe.load(PATH).encode_batch([t or "" for t in texts])]
    covered, rooms = Counter(), {}
    for r in got:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and zlib.crc32(piece.tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id] += r.length
        rooms.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert covered == Counter({i: len(x) for i, x in enumerate(ids)})
    for own in rooms.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert sum(sum(n for _, n in x) < 2048 for x in rooms.values()) <= 1
    assert packing.pack(documents(spark, []), PATH).count() == 0


def test_packing_fills_a_window_with_all_neighbours():
    rng = np.random.default_rng(2)
    docs = [np.append(rng.integers(base, base + 60, 40), 1) for _ in range(60) for base in (1000, 5000, 9000)]
    pieces = packing.Packer(0).shard(np.concatenate(docs), np.cumsum([len(x) for x in docs]))
    assert {doc % 3 for doc, _, _, sequence, _ in pieces if sequence == 0} == {0}


def test_packing_ranks_by_all_tokens_of_the_seed():
    seed = np.arange(100, 160)
    docs = [seed, np.arange(140, 160), np.append(np.arange(100, 116), np.arange(900, 924)), np.arange(116, 156)]
    index = packing.Index(np.concatenate(docs), np.cumsum([len(x) for x in docs]))
    used = np.array([True, False, False, False])
    assert set(index.neighbours(0, used)) == {1, 2, 3}


def brute(n, near):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(n):
        for j in range(i):
            if near(i, j):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in range(n)}


def variants(seed):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    base = [[rnd.choice(words) for _ in range(rnd.randint(20, 150))] for _ in range(25)]
    out = [" ".join(b) for b in base]
    for b in base[:8]:
        for _ in range(8):
            c = list(b)
            for _ in range(rnd.randint(0, 4)):
                c[rnd.randrange(len(c))] = rnd.choice(words)
            out.append(" ".join(c))
    return ODD + out


@pytest.mark.parametrize("tile", [2048, 8])
def test_simhash_classes(spark, tile):
    texts = variants(7)
    flat, begins, some = simhash.joined([simhash.shingle_hashes((t or "").encode(), 3) for t in texts])
    fps = np.zeros(len(texts), dtype=np.uint64)
    fps[some] = simhash.majority(flat, begins)
    want = brute(len(texts), lambda i, j: int(np.bitwise_count(fps[i] ^ fps[j])) <= 2)
    nodes = spark.createDataFrame([(int(np.int64(f)), i) for i, f in enumerate(fps.view(np.int64))], "fp long, node long").groupBy("fp").agg(F.min("node").alias("node"))
    links = simhash.linked(simhash.blocks(nodes, 2), 2, tile=tile)
    roots = {r.node: r.root for r in simhash.components(links).collect()}
    first = {int(f): i for i, f in reversed(list(enumerate(fps.tolist())))}
    assert {i: roots.get(first[int(f)], first[int(f)]) for i, f in enumerate(fps.tolist())} == want
    if tile == 2048:
        assert {r.doc_id: r.component_id for r in simhash.classes(documents(spark, texts)).collect()} == want
        assert simhash.classes(documents(spark, [])).count() == 0


def test_near_duplicates_are_exact(spark):
    texts = variants(9)
    sets = [set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in texts]
    want = brute(len(texts), lambda i, j: sets[i] == sets[j] or (len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 and bool(sets[i] & sets[j])))
    docs = documents(spark, texts)
    assert {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, tile=8).collect()} == want
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


def test_exact_links_agree_in_both_forms():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(5, 50)).astype(np.uint64)) for _ in range(60)]
    a, b = simhash.jaccard_links(sets, 0.5, None)
    want = brute(60, lambda i, j: len(np.intersect1d(sets[i], sets[j])) >= 0.5 * len(np.union1d(sets[i], sets[j])) - 1e-9)
    pairs = {(int(max(x, y)), int(min(x, y))) for x, y in zip(a, b, strict=True)}
    assert brute(60, lambda i, j: (i, j) in pairs) == want


def test_warc_round_trip(spark):
    big = "<p>x</p>" * 200
    rows = [(1, "u", big), (2, None, big), (3, "u\r\n", big + "é"), (4, "u", None), (5, "u", "s"), (6, "u", "s"), (7, "u", big), (None, "u", big)] + [(100 + k, "u", f"<html>{k} " + big) for k in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(df).collect()}
    assert len(got) == len(rows)
    for page, _, html in rows:
        body = (html or "").encode()
        assert got[page].payload_bytes == len(body) and got[page].payload_digest == hashlib.sha1(body).hexdigest()
    assert [(got[k].record_type, got[k].refers_to) for k in (1, 2, 7, 5, 6, None)] == [("revisit", 7), ("revisit", 7), ("response", None), ("response", None), ("response", None), ("revisit", 7)]
    records = [warc.record(k, "u", "response", "d", 3000, None, (f"{k} " + "abc " * 700).encode()) for k in range(64)]
    archive = warc.pack(records)
    assert int.from_bytes(archive[:4], "little") == warc.SKIPPABLE and list(warc.unpack(archive)) == records


def test_toxicity_neighbours_are_exact_and_useful(spark):
    rnd = random.Random(6)
    clean, bad = [f"c{k}" for k in range(60)], [f"bad{k}" for k in range(6)]
    docs, labels = [], []
    for i in range(600):
        toxic = i % 5 == 0
        words = [rnd.choice(clean) for _ in range(30)] + ([rnd.choice(bad) for _ in range(3)] if toxic else [])
        rnd.shuffle(words)
        docs.append((i, " ".join(words) if i != 1 else None))
        labels.append((i, 1, int(toxic)))
    d = spark.createDataFrame(docs, "doc_id long, text string")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").where("doc_id % 3 <> 1")
    m = toxicity.fit(d, lab)
    p = {r.doc_id: r.score for r in toxicity.score(d, m, evidence=False).collect()}
    held = [i for i in range(600) if i % 3 == 1]
    assert sum((p[i] >= 0.7) == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    doc, term, weight = m.entries()
    vec = [{} for _ in range(m.n)]
    for i, t, w in zip(doc.tolist(), term.tolist(), weight.tolist(), strict=True):
        vec[i][t] = w
    assert all(abs(sum(w * w for w in v.values()) - 1) < 1e-9 for v in vec if v)
    for q, (_, got) in enumerate(m.neighbours(doc, term, weight, m.n)):
        want = sorted(((-sum(w * vec[q].get(t, 0) for t, w in vec[k].items()), k) for k in range(m.n)))[: m.k]
        assert np.allclose(got, [-s for s, _ in want if s < 0])
    assert toxicity.keep_clean(d, m).count() == sum(x < 0.7 for x in p.values())
    none = toxicity.fit(d.limit(0), lab.limit(0))
    assert toxicity.score(d, none, evidence=False).agg(F.max("score")).first()[0] == 0


def test_ngram_base_scores_and_trie(spark):
    rnd = random.Random(8)
    texts = ODD + [" ".join(rnd.choice(["The cat sat on", "one more time again", f"w{rnd.randrange(300)}"]) for _ in range(rnd.randint(0, 20))) for _ in range(200)]
    trained = F.col("doc_id") % 10 != 0
    rows = {r.doc_id: r for r in ngrams.score(documents(spark, texts), trained, buckets=5).collect()}
    split = [[*bytes(t or "", "utf-8").lower().split(), b"\0end"] for t in texts]
    c = Counter(w for i, x in enumerate(split) if i % 10 for w in x)
    n, v = sum(c.values()), len(c)
    for i, x in enumerate(split):
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 10 == 0, len(x), sum(c[w] > 0 for w in x), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), rel_tol=1e-9)
    held = [i for i in range(len(texts)) if i % 10 == 0 and i not in (5,)]
    assert sum(rows[i].score for i in held) > sum(rows[i].base_score for i in held)
    rng = np.random.default_rng(1)
    pairs = np.unique(rng.integers(0, 60_000, 5000) << 16 | rng.integers(0, 60_000, 5000))
    t = ngrams.Trie(pairs >> 16, pairs & 0xFFFF, np.arange(len(pairs)))
    asked = np.unique(np.append(pairs, rng.integers(0, 1 << 32, 5000)))
    known = {int(p): k for k, p in enumerate(pairs)}
    assert t.find(asked >> 16, asked & 0xFFFF).tolist() == [known.get(int(a), -1) for a in asked]


@pytest.mark.parametrize("numbered", [None, 40])
def test_ngram_scores_of_all_words_and_pairs(spark, numbered):
    """P(w|v) of every pair by brute force, over more distinct words than have numbers."""
    rnd = random.Random(9)
    many = [f"u{i}" for i in range(61_000 if numbered is None else 300)]
    texts = ODD + [" ".join(many), " ".join(many), " ".join(many[-2000:])] + [" ".join(rnd.choice([rnd.choice(many), "the", "cat sat", "u5 u7"]) for _ in range(rnd.randint(0, 30))) for _ in range(150)]
    found = ngrams.score(documents(spark, texts), F.col("doc_id") % 10 != 0, buckets=5, **({} if numbered is None else {"numbered": numbered}))
    rows = {r.doc_id: r for r in found.collect()}
    split = [["<s>", *bytes(t or "", "utf-8").lower().split(), b"\0end"] for t in texts]
    train = [x for i, x in enumerate(split) if i % 10]
    c, pairs = Counter(w for x in train for w in x[1:]), Counter(p for x in train for p in zip(x, x[1:]))
    n, seen, mass = sum(c.values()), Counter(), Counter()
    for (v, _), k in pairs.items():
        seen[v] += k
        mass[v] += k - 0.75
    low = lambda w: (c[w] + 0.1) / (n + 0.1 * (len(c) + 1))
    p = lambda v, w: max(pairs[v, w] - 0.75, 0) / seen[v] + (1 - mass[v] / seen[v]) * low(w) if seen[v] else low(w)
    for i, x in enumerate(split):
        want = sum(math.log10(p(v, w)) for v, w in zip(x, x[1:]))
        assert abs(rows[i].score - want) <= len(x) / 8192 + 1e-6


def test_ngram_scores_of_a_chunk_of_one_text(spark):
    """A text alone in its chunk, as the last of a batch or one above the chunk's bytes is, scores as among others."""
    texts = ["one two three", "two three four five", "", "six one", "Ünl one\tnever"]
    docs, trained = documents(spark, texts), F.col("doc_id") != 4
    alone = docs.repartitionByRange(len(texts), "doc_id")
    assert sorted(r[0] for r in alone.groupBy(F.spark_partition_id()).count().select("count").collect()) == [1] * len(texts)
    rows = {r.doc_id: r for r in ngrams.score(alone, trained, buckets=3, numbered=2).collect()}
    split = [[*bytes(t, "utf-8").lower().split(), b"\0end"] for t in texts]
    c = Counter(w for x in split[:4] for w in x)
    n, v = sum(c.values()), len(c)
    together = {r.doc_id: r for r in ngrams.score(docs.coalesce(1), trained, buckets=3).collect()}
    for i, x in enumerate(split):
        assert (rows[i].n_tokens, rows[i].n_known, rows[i].train_tokens) == (len(x), sum(c[w] > 0 for w in x), n)
        assert math.isclose(rows[i].base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x), rel_tol=1e-9)
        assert abs(rows[i].score - together[i].score) <= len(x) / 4096 + 1e-6


def test_secrets_equal_a_full_scan(spark):
    texts = ODD + ['Password = "abcdef12"', "api_key:abc", "apikey: abcdefg token=abcdef", "AKIA" + "Z9" * 8, "AKIA12", "0" * 23 + " " + "ab" * 12, "ſecret=abcdefgh KELVIN toKen=abcdefg", "-----BEGIN RSA PRIVATE KEY-----", "x ghp_" + "a1" * 18, "http://u:pass@h"]
    s = secrets.scanner()
    got = {r.doc_id: [(x.kind, x.start, x.end) for x in r.spans] for r in secrets.find(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = sorted((m.start(), k, m.end()) for k, (rule, p) in enumerate(zip(s.rules, s.compiled, strict=True)) for m in p.finditer(t or "") if len(m.group(rule.group)) >= rule.least)
        assert got[i] == [(s.rules[k].kind, a, b) for a, k, b in want]
    assert all(q is None for r, q in zip(s.rules, s.queries, strict=True) if r.kind == "hex") and s.queries[0]
    clean = secrets.redact(documents(spark, texts))
    assert all(not r.spans for r in secrets.find(clean).collect())
    assert clean.where("doc_id = 0 and text is null").count() == 1
