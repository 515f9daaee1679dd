import hashlib
import itertools
import random
import zlib

import numpy as np
import pytest

from quire.llm import chat, crf_quality, gif


@pytest.mark.parametrize("n,letters", itertools.product((0, 1, 2, 5, 300, 12000), (1, 2, 256)))
def test_lzw_round_trip(n, letters):
    random.seed(n)
    data = bytes(random.randrange(letters) for _ in range(n))
    assert gif.lzw_decode(gif.lzw_encode(data)) == data


def test_lzw_small_codes_and_bad_streams():
    data = bytes(random.Random(1).randrange(4) for _ in range(20000))
    assert gif.lzw_decode(gif.lzw_encode(data, 2), 2) == data
    with pytest.raises(ValueError):
        gif.lzw_decode(b"\xff\xff\xff")


def test_known_file():
    # ten by ten pixels, four colours, one frame: the sample of the format's public description
    data = bytes.fromhex(
        "47494638396 10a000a00910000ffffffff00000000ff00000021f90400000000002c000000000a000a0000"
        "02168c2d99872a1cdc33a00275ec95faa8de608c04914c01003b".replace(" ", "")
    )
    (frame,) = gif.read_gif(data)
    assert frame.indices.shape == (10, 10) and frame.indices[0].tolist() == [1] * 5 + [2] * 5
    assert gif.colour_histogram(frame.canvas).sum() == 300


def test_disposal_and_transparency():
    full, dot = np.zeros((2, 192), np.uint8), np.full((2, 192), 7, np.uint8)
    dot[0, 0] = 255
    data = gif.write_gif([full, dot], disposal=2, transparent=7)
    first, second = gif.read_gif(data)
    assert (first.canvas[..., 3] == 255).all()
    assert second.canvas[0, 0].tolist() == [255, 255, 255, 255] and second.canvas[1, 1, 3] == 0
    kept = list(gif.read_gif(gif.write_gif([full, dot], disposal=1, transparent=7)))[1]
    assert kept.canvas[1, 1].tolist() == [0, 0, 0, 255]
    back = list(gif.read_gif(gif.write_gif([full, dot, dot], disposal=3, transparent=7)))[2]
    assert back.canvas[1, 1, 3] == 0


def naive_codes(stream, bits):
    """Bit by bit, one dictionary entry at a time."""
    clear, stop = 1 << bits, (1 << bits) + 1
    width, table, last, out, at = bits + 1, {}, None, b"", 0
    number = int.from_bytes(stream, "little")
    while at + width <= 8 * len(stream):
        code = number >> at & ((1 << width) - 1)
        at += width
        if code == stop:
            break
        if code == clear:
            width, last, table = bits + 1, None, {i: bytes([i]) for i in range(clear)}
            continue
        entry = table[code] if code in table else last + last[:1]
        if last is not None and len(table) + 2 < 4096:
            table[len(table) + 2] = last + entry[:1]
        out, last = out + entry, entry
        width = max(width, min(12, (len(table) + 2).bit_length()))
    return out


def naive_gif(data, levels=4):
    """(samples, frames) of a file, pixel by pixel: the format read without any code of the operator."""
    wide, high = data[6] | data[7] << 8, data[8] | data[9] << 8
    palette = [tuple(data[13 + 3 * i : 16 + 3 * i]) for i in range(256)]
    at, canvas, samples, frames, start, control = 13 + 768, {}, b"", [], 0, None
    while data[at] != 0x3B:
        kind, label = data[at], data[at + 1]
        head = data[at + 1 : at + 10]
        at += 2 if kind == 0x21 else 10
        bits = 0
        if kind == 0x2C:
            bits, at = data[at], at + 1
        body = b""
        while data[at]:
            body, at = body + data[at + 1 : at + 1 + data[at]], at + 1 + data[at]
        at += 1
        if kind == 0x21:
            control = body if label == 0xF9 else control
            continue
        w, h = head[4] | head[5] << 8, head[6] | head[7] << 8
        pixels = naive_codes(body, bits)
        samples += pixels
        disposal, delay, clear = control[0] >> 2 & 7, control[1] | control[2] << 8, control[3] if control[0] & 1 else None
        before = dict(canvas)
        for i, sample in enumerate(pixels):
            if sample != clear:
                canvas[i % w, i // w] = palette[sample]
        counts = [[sum(c[k] * levels // 256 == b for c in canvas.values()) for b in range(levels)] for k in range(3)]
        frames.append((start, 10 * delay, disposal, clear, wide, high, *counts))
        start += 10 * delay
        if disposal == 3:
            canvas = before
        if disposal == 2:
            for i in range(w * h):
                canvas.pop((i % w, i // w), None)
    return samples, frames


def test_documents_as_gif(awkward, rows, nothing):
    stored = gif.store_as_gif(awkward)
    media = {r.doc_id: r.media for r in stored.collect()}
    decoded = gif.decode_media(stored)
    got = {}
    for r in gif.gif_features(decoded).collect():
        got.setdefault(r.doc_id, r)
    for doc_id, text in rows:
        raw = text.encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(media[doc_id]), hashlib.sha256(media[doc_id]).hexdigest())
        if len(payload) < 40_000:
            samples, frames = naive_gif(media[doc_id])
            assert samples == payload
            assert frames == [(f.start_ms, f.delay_ms, f.disposal, f.transparent, f.width, f.height, f.red, f.green, f.blue) for f in r.frames]
            sums = [sum(f[6 + k][b] for f in frames) for k in range(3) for b in range(4)]
            assert r.feature == f"frames={len(frames)};ms={sum(f[1] for f in frames)};rgb=" + ",".join(map(str, sums))
    assert got[5].media_sha256 == got[6].media_sha256 and got[5].feature == got[6].feature
    assert gif.gif_features(gif.decode_media(gif.store_as_gif(nothing))).count() == 0
    frames = gif.timed_frames(decoded).collect()
    assert len(frames) == sum(len(r.frames) for r in gif.gif_features(decoded).collect())
    assert all(0 < sum(f.red) == sum(f.green) == sum(f.blue) <= f.width * f.height or not sum(f.red) for f in frames)


def test_disposal_and_transparency_of_stored_frames(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("ab cd  éz") for _ in range(4 * 192))
    frames = [np.frombuffer(gif.payload_of(text.encode()), np.uint8).reshape(-1, 192)[i : i + 1] for i in range(4)]
    data = gif.write_gif(frames, disposal=gif.DISPOSALS, transparent=gif.CLEAR)
    row = gif.gif_features(gif.decode_media(spark.createDataFrame([(1, 0, data)], "doc_id long, n_bytes long, media binary"))).first()
    _, want = naive_gif(data)
    assert [f[2] for f in want] == [1, 2, 3, 1]
    assert [(f.start_ms, f.delay_ms, f.disposal, f.transparent, f.width, f.height, f.red, f.green, f.blue) for f in row.frames] == want


def test_broken_media_have_a_problem(spark):
    good = gif.write_gif([np.zeros((1, 192), np.uint8)] * 2)
    rows = [(1, 0, None), (2, 0, b"no gif"), (3, 0, good[:-40]), (4, 0, good), (5, 0, b"")]
    got = {r.doc_id: r for r in gif.decode_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert all(got[i].problem and not got[i].frames for i in (1, 2, 5)) and got[3].problem and len(got[3].frames) == 1
    assert got[4].problem is None and len(got[4].frames) == 2


def brute_chats(rows):
    logs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            logs.setdefault(conv, []).append((-1 if turn is None else turn, role or "", text or ""))
    said = {c: [(r, t) for _, r, t in sorted(v)] for c, v in logs.items()}
    keep = [
        c for c, s in said.items()
        if not any(o != c and u[: len(s)] == s and (len(u) > len(s) or o < c) for o, u in said.items())
    ]
    return sorted((c, len(said[c]), "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n".replace("<|x", "< |x") for r, t in said[c])) for c in keep)


def test_tied_turns_go_by_their_texts(spark):
    rows = []
    for k in range(40):
        # turns that share number and role: the shorter log is the first of the longer one's texts, or is not
        rows += [(2 * k, 0, "user", f"a{k}"), (2 * k + 1, 0, "user", f"a{k}"), (2 * k + 1, 0, "user", f"b{k}")]
        rows += [(1000 + 2 * k, None, "user", f"d{k}"), (1001 + 2 * k, None, "user", f"c{k}"), (1001 + 2 * k, None, "user", f"d{k}")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((r.conv_id, r.n_turns, r.rendered) for r in chat.format_chats(df).collect()) == brute_chats(rows)


def test_chats(spark):
    random.seed(6)
    rows = []
    base = [[("user", f"q{i} {k}") if k % 2 == 0 else ("assistant", f"a{k}") for k in range(6)] for i in range(5)]
    for c in range(60):
        b, n = random.choice(base), random.randint(1, 6)
        rows += [(c, k, *b[k]) for k in range(n)]
    rows += [(100, None, None, None), (101, None, None, None), (None, 1, "user", "x"), (102, 0, "user", "has <|x marker"), (103, 0, "user", "t"), (103, 0, "user", "t")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for block, each in ((4096, 200_000), (2, 200_000), (2, 7), (4096, 3)):
        parts = chat.format_chats(df, block, each).collect()
        assert all(r.part_turns <= block for r in parts)
        got = {}
        for r in sorted(parts, key=lambda r: r.part):
            n, text = got.get(r.conv_id, (r.n_turns, ""))
            got[r.conv_id] = (n, text + r.rendered)
        assert sorted((c, n, t) for c, (n, t) in got.items()) == brute_chats(rows)
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_and_tied_conversations_are_cut_by_place(spark):
    rows = [(1, None, "user", f"t{i % 50:03}") for i in range(900)] + [(2, 7, "user", "same")] * 300 + [(3, 7, "user", "same")] * 301 + [(4, i, None, None) for i in range(400)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, run string, k int")
    parts = chat.format_chats(df, 64, 100).collect()
    assert max(r.part_turns for r in parts) == 64
    got = {}
    for r in sorted(parts, key=lambda r: r.part):
        n, text = got.get(r.conv_id, (r.n_turns, ""))
        got[r.conv_id] = (n, text + r.rendered)
    assert sorted((c, n, t) for c, (n, t) in got.items()) == brute_chats(rows)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(0)
    emission, step = rng.normal(size=9), rng.normal(size=(2, 2))
    per_doc = np.array([3, 1, 5])
    good, pair = crf_quality.marginals(emission, per_doc, step)
    at = 0
    for n in per_doc:
        total, each, both = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for labels in itertools.product((0, 1), repeat=int(n)):
            w = np.exp(sum(emission[at + i] * y for i, y in enumerate(labels)) + sum(step[a, b] for a, b in zip(labels, labels[1:])))
            total += w
            each += w * np.array(labels)
            for i in range(1, n):
                both[i, labels[i - 1], labels[i]] += w
        assert np.allclose(each / total, good[at : at + n]) and np.allclose(both[1:] / total, pair[at + 1 : at + n])
        at += n


def brute_line(line):
    """The sixteen features of a line, character by character; repeats need the document and come as zero."""
    raw = line.encode()
    space = lambda c: c == 32 or 9 <= c <= 13
    stop = b".,;:?'\"()-"
    letter = lambda c: 65 <= c <= 90 or 97 <= c <= 122 or c >= 128
    symbol = lambda c: not (space(c) or 48 <= c <= 57 or letter(c) or c in stop or c in b"!|")
    classes = [lambda c: 65 <= c <= 90, lambda c: 48 <= c <= 57, lambda c: c in stop, lambda c: c == 33, lambda c: c == 124, symbol, lambda c: c >= 128, space]
    words = raw.split()
    n, many = max(1, len(raw)), max(1, len(words))
    shares = [sum(map(f, raw)) / n for f in classes]
    return shares + [
        sum(a == b for a, b in zip(words, words[1:])) / many, len(set(words)) / many, sum(symbol(w[-1]) or w[-1] == 33 for w in words) / many,
        sum(map(len, words)) / many / 10, sum(len(w) <= 3 for w in words) / many, np.log1p(len(raw)) / 10, 0.0, float(not words),
    ]


def brute_score(crf, text):
    """Features, neighbours, enumeration of all labellings, length weights, calibration."""
    lines = text.split("\n")
    x = np.array([brute_line(t) for t in lines])
    x[:, 14] = [lines.count(t) > 1 for t in lines]
    zero = np.zeros(x.shape[1])
    wide = [np.concatenate([x[i], x[i - 1] if i else zero, x[i + 1] if i + 1 < len(x) else zero]) for i in range(len(x))]
    emission = [float(np.clip((w - crf.mean) / crf.scale, -6, 6) @ crf.weight + crf.bias) for w in wide]
    total, good = 0.0, np.zeros(len(x))
    for labels in itertools.product((0, 1), repeat=len(x)):
        w = np.exp(sum(e * y for e, y in zip(emission, labels)) + sum(crf.step[a, b] for a, b in zip(labels, labels[1:])))
        total, good = total + w, good + w * np.array(labels)
    size = np.array([len(t.encode()) + 1.0 for t in lines])
    share = np.clip((good / total) @ size / size.sum(), 1e-6, 1 - 1e-6)
    return 1 / (1 + np.exp(-(crf.slope * np.log(share / (1 - share)) + crf.shift)))


LINES = ["The first line, with Some words.", "", "!!! $$$ buy | now 99", "the the the", "ünïcode — dash", "a b c d e f", "The first line, with Some words.", " \t ", "12 345"]


def test_scores_equal_brute_force():
    rng = np.random.default_rng(7)
    wide = 3 * crf_quality.FEATURES
    crf = crf_quality.Crf(rng.normal(0, 0.2, wide), rng.uniform(0.2, 1, wide), rng.normal(0, 0.3, wide), 0.1, rng.normal(size=(2, 2)), 1.7, -0.4)
    random.seed(7)
    texts = ["", "\n", *("\n".join(random.choices(LINES, k=random.randint(1, 8))) for _ in range(30))]
    got = crf.document_scores([t.encode() for t in texts])
    assert np.allclose(got, [brute_score(crf, t) for t in texts], atol=1e-9)


def test_gradient_equals_differences():
    rng = np.random.default_rng(8)
    wide = 3 * crf_quality.FEATURES
    x, per_doc = rng.random((9, crf_quality.FEATURES)), np.array([3, 1, 5])
    label, weight = np.array([1, 0, 0]), np.array([0.5, 0.2, 0.3])

    def at(theta):
        crf = crf_quality.Crf(np.full(wide, 0.5), np.full(wide, 0.3), theta[:wide], theta[wide], theta[wide + 1 :].reshape(2, 2))
        return crf_quality.likelihood(crf, x, per_doc, label, weight)

    theta = rng.normal(0, 0.3, wide + 5)
    value, grad = at(theta)
    # the value by enumeration
    crf = crf_quality.Crf(np.full(wide, 0.5), np.full(wide, 0.3), theta[:wide], theta[wide], theta[wide + 1 :].reshape(2, 2))
    emission, first, want = crf.emissions(crf_quality.with_neighbours(x, per_doc)), 0, 0.0
    for n, y, w in zip(per_doc, label, weight):
        score = lambda ys: sum(emission[first + i] * v for i, v in enumerate(ys)) + sum(crf.step[a, b] for a, b in zip(ys, ys[1:]))  # noqa: B023, E731
        want += w / n * (score([y] * n) - np.log(sum(np.exp(score(ys)) for ys in itertools.product((0, 1), repeat=int(n)))))
        first += n
    assert np.isclose(value, want)
    for k in range(0, wide + 5, 7):
        step = np.zeros(wide + 5)
        step[k] = 1e-5
        assert np.isclose((at(theta + step)[0] - at(theta - step)[0]) / 2e-5, grad[k], atol=1e-6)


def test_training_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(30)] + [(1, "other text"), (None, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(5, 0), (6, 0), (None, 1), (7, None), (8, 3)], "doc_id long, quality int")
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 4 == 2]
    got = crf_quality.training_sample(docs, labels).collect()
    # held-out ids, the id whose labels differ and ids without a document are not learnt from
    assert sorted(r.doc_id for r in got) == [i for i in range(30) if i not in held and i != 5]
    assert len(crf_quality.training_sample(docs, labels, 4).collect()) == 4
    long = "\n".join(f"line {i}" for i in range(5000))
    one = crf_quality.training_sample(spark.createDataFrame([(1, long)], "doc_id long, text string"), labels).first()
    assert one.text == long


def test_quality_filter_decides_on_rows(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    texts = [r.text for r in docs.collect()]
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    # every id has two texts, and one row stands twice
    both = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, "x"), (3, None)], "doc_id long, text string")
    model = crf_quality.train(both, labels)
    score = lambda t: model.document_scores([(t or "").encode()])[0]
    want = sorted((r.doc_id, r.text or "") for r in both.collect() if r.doc_id is not None and score(r.text) >= 0.7)
    assert sorted((r.doc_id, r.text or "") for r in crf_quality.keep_good(both, labels).collect()) == want
    kept = crf_quality.keep_good(awkward, labels)
    assert kept.schema == awkward.schema and all(r.doc_id is not None for r in kept.collect())


def test_quality(spark, awkward, nothing):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = {r.doc_id: r for r in crf_quality.quality_scores(docs, labels).collect()}
    assert len(got) == docs.count()
    known = [(got[r.doc_id], r.quality) for r in labels.collect()]
    held = [(s.predicted, q) for s, q in known if s.held_out]
    assert all(s.held_out == (zlib.crc32(str(s.doc_id).encode()) % 4 == 2) for s, _ in known)
    assert sum(p == q for p, q in held) >= 0.97 * len(held)
    odd = crf_quality.quality_scores(awkward, labels).collect()
    assert len(odd) == 13 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in odd)
    assert crf_quality.quality_scores(nothing, labels).count() == 0
    blank = crf_quality.quality_scores(docs.limit(3), labels.limit(0)).collect()
    assert [r.score for r in blank] == [0.5] * 3
