import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from veilframe.llm import media, mix_sources, near_dedup, pack, phrase_dedup, quality, run_length_dedup, token_files, tokenise, topk, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, __id string, extra map<string,int>"


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    vocab = [f"w{i}" for i in range(300)] + ["É", "ß,", "trash"]
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 200))) for _ in range(25)]
    texts = [*base, base[3], base[3], "", " \t\n", "one two", "One  two", "x" * 400, "a " * 300]
    for t in base[:12]:  # near copies and shared passages
        w = t.split()
        w[len(w) // 2] = "changed"
        texts += [" ".join(w), "intro " + t[: len(t) // 2] + " outro " + base[-1][:200]]
    texts += ["long " + " ".join(r.choice(vocab) for _ in range(6000))]
    out = [(i, t, f"s{i % 4}" if i % 5 else None, "x", None) for i, t in enumerate(texts)]
    return [*out, (len(out), None, "s1", None, None), out[7]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def distinct(rows):
    return sorted({r[0]: r[1] or "" for r in rows}.items())


def test_mix(docs, none, rows):
    got = mix_sources.sample_copies(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 3 for r in got)
    assert {(r.doc_id, r["size"]) for r in got} == {(r[0], len(WORD.findall(r[1] or ""))) for r in rows}
    assert sum({r.source: r.target for r in got}.values()) == pytest.approx(sum(r["size"] for r in got))
    assert mix_sources.mixed_documents(docs).count() == sum(r.copies for r in got)
    assert not mix_sources.sample_copies(none).count() and not mix_sources.mixed_documents(none).count()


def test_token_files(docs, none, rows):
    enc, start = tokenise.encoder(tokenise.default_path()), 0
    got = {r.doc_id: r for r in token_files.read_token_files(token_files.write_token_files(docs), with_ids=True).collect()}
    for doc, text in sorted((r[0], r[1] or "") for r in rows):
        ids = np.array(enc.tok.encode(text, add_special_tokens=False).ids + [2], "<u4")
        assert got[doc].n_tokens == len(ids) and got[doc].ids_crc32 == zlib.crc32(ids.tobytes()) and got[doc].ids == ids.tolist()
        if doc != rows[-1][0]:
            assert got[doc].start == start
        start += len(ids)
    assert not token_files.read_token_files(token_files.write_token_files(none)).count()


def test_pack(docs, none, rows):
    got = pack.pack_documents(docs, capacity=128, with_ids=True)
    pieces = got.collect()
    used = sum(r["length"] for r in pieces)
    full = {}
    for r in pieces:
        full.setdefault(r.sequence_id, []).append((r.offset, r["length"]))
    for own in full.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 128
    bins: list[int] = []  # plain first-fit decreasing
    for n in sorted((r["length"] for r in pieces), reverse=True):
        i = next((i for i, room in enumerate(bins) if room >= n), len(bins))
        bins[i : i + 1] = [(bins[i] if i < len(bins) else 128) - n]
    assert -(-used // 128) <= len(full) <= len(bins) and pack.sequences(got).count() == len(full)
    assert not pack.pack_documents(none).count()


def test_reduction_fixes_only_what_fits():
    r = random.Random(1)
    for _ in range(100):
        counts = {}
        for _ in range(r.randint(0, 40)):
            counts[r.randint(1, 50)] = r.choice([1, 2, 3, 50])
        got = {}
        for pattern, m in pack.plan(counts, 50):
            assert sum(s * q for s, q in pattern) <= 50
            for s, q in pattern:
                got[s] = got.get(s, 0) + q * m
        assert got == counts


def test_media(docs, none, rows):
    got = {r.doc_id: r for r in media.media_column(docs, with_media=True).collect()}
    for doc, text in distinct(rows):
        raw = text.encode()
        payload = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[doc]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert r.media_sha256 == hashlib.sha256(r.media).hexdigest()
    assert media.packet_table(media.media_column(docs, True), "doc_id", "media").count() > 0
    assert not media.media_column(none).count()


def test_media_lacing():
    def block(flags, body):
        return media.element(media.SIMPLE_BLOCK, b"\x81\x00\x05" + bytes([flags]) + body)

    xiph = block(0x02, bytes([2, 255, 1, 3]) + b"a" * 256 + b"b" * 3 + b"c" * 4)
    cluster = b"\x1f\x43\xb6\x75\xff" + media._uint(media.CLUSTER_TIMESTAMP, 100) + xiph  # of unknown size
    found = media.parse(media._HEAD + b"\x18\x53\x80\x67\xff" + cluster + cluster)
    assert [p[3] for p in found.packets] == [256, 3, 4] * 2 and {p[1] for p in found.packets} == {105} and len(found.clusters) == 2
    with pytest.raises(media.MediaError):
        media.parse(media.mux_pcm(b"x" * 5000)[:-7])


def test_near_duplicates(docs, none, rows):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for doc, text in distinct(rows):
        w = WORD.findall(text.translate(low))
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a != b and sets[a] and 100 * both >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    got = near_dedup.near_duplicates(docs).collect()
    assert {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got} == {(d, len(s), root[d], root[d] == d) for d, s in sets.items()}
    assert not near_dedup.near_duplicates(none).count()


@pytest.mark.parametrize(("hot", "local"), [(10_000, 64), (2, 64), (10_000, 1)])
def test_phrases(docs, none, rows, monkeypatch, hot, local):
    monkeypatch.setattr("veilframe.llm.passages.HOT", hot)
    monkeypatch.setattr("veilframe.llm.passages.LOCAL_HOT", local)
    if hot == 2:
        monkeypatch.setattr(phrase_dedup, "AUTOMATON_WORDS", 50)
    first, want = {}, set()
    for doc, text in distinct(rows):
        w, gone = WORD.findall(text), set()
        for i in range(len(w) - 19):
            if first.setdefault(tuple(w[i : i + 20]), (doc, i)) != (doc, i):
                gone |= set(range(i, i + 20))
        want.add((doc, len(w), len(gone), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()))
    assert {tuple(r) for r in phrase_dedup.phrase_digest(docs).collect()} == want
    assert phrase_dedup.without_repeated_phrases(docs).columns == docs.columns and not phrase_dedup.phrase_digest(none).count()


@pytest.mark.parametrize(("hot", "local"), [(10_000, 64), (2, 64), (10_000, 1)])
def test_run_length_index(docs, none, rows, monkeypatch, hot, local):
    monkeypatch.setattr("veilframe.llm.passages.HOT", hot)
    monkeypatch.setattr("veilframe.llm.passages.LOCAL_HOT", local)
    first, want = {}, set()
    for doc, text in distinct(rows):
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first.setdefault(b[i : i + 50], doc) != doc:
                gone[i : i + 50] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want.add((doc, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    assert {tuple(r) for r in run_length_dedup.run_length_digest(docs).collect()} == want
    assert not run_length_dedup.run_length_digest(none).count()


def test_top_k(spark):
    r = np.random.default_rng(2)
    v = r.standard_normal((300, 16)).astype(np.float32) * r.random((300, 1)).astype(np.float32)
    v[50:60] = v[40]
    data = [(i, x.tolist(), 0) for i, x in enumerate(v)] + [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")] * 16, 1), (903, [float("inf")] * 16, 1)]
    got = topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<float>, score int"), k=5, query_every=20).collect()
    ints = np.floor(1024 * v.astype(np.float64)).astype(int)
    want = set()
    for q in range(0, 300, 20):
        s = ints @ ints[q]
        best = sorted((-int(s[i]), i) for i in range(300) if i != q)[:5]
        want |= {(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)}
    assert {tuple(x) for x in got} == want
    assert not topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count()


def test_learned(spark, docs, none):
    path = "/root/testdata/sf0.01"
    d, labels = (spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels"))
    for f, column, least in ((quality.op4_attention_quality, "quality", 0.95), (toxicity.op6_factorization_toxicity, "toxic", 0.85)):
        got = f(spark, path).where("held_out").join(labels, "doc_id").select("predicted", column).collect()
        assert sum(r[0] == r[1] for r in got) / len(got) >= least
    empty = labels.limit(0)
    assert quality.with_quality(docs, quality.fit(docs, empty)).count() == docs.count()
    model = quality.fit(d, labels)
    scores = [r.score for r in quality.with_quality(docs, model).collect()]
    assert all(0 <= s <= 1 for s in scores) and not quality.with_quality(none, model).count()
    scores = [r.score for r in toxicity.with_toxicity(docs, toxicity.fit(d, labels)).collect()]
    assert all(0 <= s <= 1 for s in scores)


def test_pipeline(spark):
    import corpus_pipeline as p

    assert [n for n, _ in p.STAGES] == ["quality", "near_duplicates", "repeats", "mix", "pack"]
    assert p.run(spark, "/root/testdata/sf0.001").count() > 0


@pytest.mark.parametrize(("hot", "local"), [(2, 64), (10_000, 1)])
def test_repeats_within_first_documents(spark, monkeypatch, hot, local):
    """A passage stands twice in each of several documents of every task."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    monkeypatch.setattr("veilframe.llm.passages.HOT", hot)
    monkeypatch.setattr("veilframe.llm.passages.LOCAL_HOT", local)
    rule = "-" * 80 + "The same passage, which every document holds in two places of its own."
    texts = {i: f"{i} begins {rule} middle {i * 7919} {rule} ends {i}" for i in range(40)}
    first, want = {}, {}
    for doc, text in sorted(texts.items()):
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first.setdefault(b[i : i + 50], doc) != doc:
                gone[i : i + 50] = True
        want[doc] = int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
    try:
        got = run_length_dedup.run_length_digest(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in got} == want


def test_rows_without_an_id(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    texts = ["one text", "other text", "other text", None, f"a {passage}", f"b {passage}"]
    rows = [(None, t, i) for i, t in enumerate(texts)] + [(5, "one text", 10), (5, "one text", 11), (-(1 << 40), f"c {passage}", 12), (7, "far away", 13)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    cut = {r.n: r.text for r in phrase_dedup.without_repeated_phrases(docs).collect() if r.n not in (10, 11)}
    assert cut == {0: "one text", 1: "other text", 2: "other text", 3: None, 4: f"a {passage}", 5: "b ", 12: "c ", 13: "far away"}
    got = [(r.doc_id, r.n_words, r.n_removed) for r in phrase_dedup.phrase_digest(docs).collect()]
    assert sorted(got, key=str) == sorted([(None, n, 0) for n in (0, 2, 2, 2, 31)] + [(None, 31, 30), (5, 2, 0), (-(1 << 40), 31, 30), (7, 2, 0)], key=str)
    got = [(r.doc_id, r.n_bytes, r.n_removed > 0) for r in run_length_dedup.run_length_digest(docs).collect()]
    n = len(passage) + 2
    assert sorted(got, key=str) == sorted([(None, x, False) for x in (0, 8, 10, 10, n)] + [(None, n, True), (5, 8, False), (-(1 << 40), n, True), (7, 8, False)], key=str)
    left = near_dedup.without_near_duplicates(docs)
    assert left.columns == docs.columns
    left = [r.n for r in left.collect()]
    assert sorted(set(left) - {10, 11}) == [0, 1, 2, 3, 4, 5, 12, 13] and len(left) == 9


def test_added_tokens(spark):
    import tokenizers

    plain = tokenizers.Tokenizer.from_file(tokenise.default_path())
    texts = ["end of it.<|endoftext|>Next", "a <|endoftext|> b", "<|endoftext|>", "<|endoftext |> no", "x<|endoftext|><|endoftext|> y  z ", "plain text only"]
    enc = tokenise.Encoder(tokenise.default_path())
    for _ in range(2):  # the second time from the cache
        got = [np.frombuffer(b, enc.dtype).tolist() for b in enc.encode_many(texts)]
        assert got == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = {i: plain.encode(t, add_special_tokens=False).ids + [2] for i, t in enumerate(texts)}
    assert {r.doc_id: r.ids for r in token_files.read_token_files(token_files.write_token_files(docs), with_ids=True).collect()} == want
    assert {r.doc_id: r["length"] for r in pack.pack_documents(docs).collect()} == {i: len(x) for i, x in want.items()}


def test_texts_keep_their_spacing(spark):
    passage = "\n".join(f"p{i}" for i in range(25))
    texts = ["  clean\ttext\n\nof lines \n", f"first\n{passage}\tend", f" second\t{passage}\n\nlast  line\n", f"{passage}", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in phrase_dedup.without_repeated_phrases(docs).collect()}
    assert got == dict(enumerate([*texts[:2], " second\t\n\nlast  line\n", "", None, ""]))


def test_pipeline_stages(spark, tmp_path):
    """Each stage by brute force, on null ids, line breaks, repeated rows and ties."""
    from collections import Counter

    import corpus_pipeline as p

    r = random.Random(8)
    words = lambda n: [f"v{r.randint(0, 400)}" for _ in range(n)]
    passage = "\n".join(words(30))
    base = [words(60) for _ in range(6)]
    texts = ["\n".join(base[0]), " ".join(base[0]), " ".join([*base[1], "more"]), " ".join(base[1]), f"x\n{passage}\ty", f" z {passage}\n\nw", "line one\nline two\n", "", None, " ".join(base[2])]
    rows = [(i, t, f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)]
    rows += [(None, t, "s1", len(t)) for t in (" ".join(base[3]), "no id\nat all", "no id\nat all", " ".join(base[0]))] + [rows[6]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3)
    counted = lambda df: Counter(tuple(x) for x in df.collect())

    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = quality.fit(docs, labels)
    good = counted(quality.with_quality(docs, model).where("score >= 0.5").select(*docs.columns))
    assert counted(p.keep_good(spark, docs, str(tmp_path))) == good and set(good) <= set(rows)

    sets = {}
    for doc, text, *_ in rows:
        w = (text or "").split()
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())
    near = lambda a, b: bool(sets[a]) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    # no chains here: a document stays if it has no smaller near copy
    stay = [d for d in range(10) if not any(near(d, e) for e in range(d))]
    assert stay == [0, 2, 4, 6, 7, 8, 9]
    assert counted(p.drop_near_copies(spark, docs, "")) == Counter([rows[d] for d in stay] + rows[10:14])

    seen, want = set(), Counter()
    distinct_rows = sorted((x for x in rows if x[0] is None), key=lambda x: x[1]) + rows[:10]
    for doc, text, source, _ in distinct_rows:
        spans = [m.span() for m in WORD.finditer(text or "")]
        w, gone = [text[a:b] for a, b in spans], set()
        for i in range(len(w) - 19):
            if tuple(w[i : i + 20]) in seen:
                gone |= set(range(i, i + 20))
            seen.add(tuple(w[i : i + 20]))
        cut = [any({i, i + 1} <= gone and b <= at < spans[i + 1][0] for i, (_, b) in enumerate(spans[:-1])) or any(i in gone and a <= at < b for i, (a, b) in enumerate(spans)) for at in range(len(text or ""))]
        text = None if text is None else "".join(c for c, x in zip(text, cut) if not x)
        want[doc, text, source, None if text is None else len(text)] += 1
    assert counted(p.cut_repeats(spark, docs, "")) == want

    copies = Counter()
    slim = mix_sources.sample_copies(docs)
    for x in slim.collect():
        copies[x.doc_id, x["source"]] += x.copies
    mixed = p.mix(spark, docs, "").collect()
    got = Counter((x.doc_id, x["source"]) for x in mixed)
    assert got == +copies and {tuple(x) for x in mixed} <= set(rows)

    import tokenizers

    plain = tokenizers.Tokenizer.from_file(tokenise.default_path())
    lengths = Counter((doc, len(plain.encode(text or "", add_special_tokens=False).ids) + 1) for doc, text, *_ in rows)
    assert Counter((x.doc_id, x["length"]) for x in p.pack_sequences(spark, docs, "").collect()) == lengths


def _auc(y, score):
    order = np.argsort(score)
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    n = y.sum()
    return (rank[y > 0].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def test_toxicity_of_a_pair_that_tells_nothing_alone():
    import pyarrow as pa

    def made(n, seed):
        r, texts, y = random.Random(seed), [], []
        for _ in range(n):
            w, a, b = [f"w{r.randint(0, 300)}" for _ in range(30)], r.random() < 0.5, r.random() < 0.5
            for held, term in ((a, "ratlike"), (b, "islander")):
                if held:
                    w.insert(r.randint(0, 30), term)
            texts.append(" ".join(w))
            y.append(float(a == b))
        blocks = [toxicity.terms(block) for block in toxicity.text_blocks(pa.array(texts))]
        return pa.array(texts), [x[i:j].astype(np.int32) for x, at in blocks for i, j in zip(at, at[1:])], np.array(y)

    _, sets, y = made(1200, 1)
    model = toxicity.train(sets, y)
    texts, _, want = made(400, 2)
    assert _auc(want, toxicity.scorer(model)(texts)) >= 0.95
    alone = toxicity.scorer(model | {"v": np.zeros_like(model["v"])})(texts)
    assert _auc(want, alone) <= 0.65


def test_toxicity_on_held_out_rows(spark):
    path = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{path}/labels.parquet")
    rows = toxicity.op6_factorization_toxicity(spark, path).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    y, score, said = (np.array([float(r[k]) for r in rows]) for k in ("toxic", "score", "predicted"))
    assert _auc(y, score) >= 0.97 and (said * y).sum() / y.sum() >= 0.85 and (said * y).sum() / said.sum() >= 0.85


def test_one_passage_of_many_decides(monkeypatch):
    import pyarrow as pa

    def made(n, seed):
        r, texts, y = random.Random(seed), [], []
        for _ in range(n):
            parts = [" ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(48)) for _ in range(r.randint(10, 40))]
            y.append(float(r.random() < 0.5))
            if y[-1]:  # one passage with some numbers
                parts[r.randrange(len(parts))] = " ".join(str(r.randint(1, 999)) if i % 4 == 0 else "abc" for i in range(48))
            texts.append(" ".join(parts))
        blocks = [quality.passages(block) for block in quality.text_blocks(pa.array(texts))]
        return pa.array(texts), [x[i:j] for x, at in blocks for i, j in zip(at, at[1:])], np.array(y)

    _, bags, y = made(400, 3)
    model = quality.train(bags, y)
    texts, _, want = made(200, 4)
    right = lambda m: ((quality.scorer(m)(texts) >= 0.5) == (want > 0.5)).mean()
    assert right(model) >= 0.95 and right(model | {"w": np.zeros_like(model["w"])}) <= 0.8


def test_mix_keeps_every_row_whole(spark):
    from collections import Counter

    rows = [(i % 7 if i % 5 else None, "word " * (i % 9), f"s{i % 2}" if i % 3 else None, i, "kept") for i in range(60)]
    rows += [(3, "the same text", "s1", 100 + i, "kept") for i in range(6)]  # alike but for one column
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __mix_id int, copies string").repartition(4)
    got = Counter(tuple(r) for r in mix_sources.mixed_documents(docs).collect())
    assert set(got) <= set(rows) and max(got.values()) <= 3
    copies = mix_sources.sample_copies(docs)
    assert Counter() + Counter((r.doc_id, r.source, len(WORD.findall(r.text))) for r in mix_sources.mixed_documents(docs).collect()) == +sum((Counter({(r.doc_id, r.source, r["size"]): r.copies}) for r in copies.collect()), Counter())


def test_mix_takes_what_it_aims_at(docs, spark):
    from collections import Counter

    for table in (docs, spark.read.parquet("/root/testdata/sf0.01/documents.parquet")):
        rows = mix_sources.sample_copies(table).collect()
        taken, target, size, largest = Counter(), {}, {}, Counter()
        for r in rows:
            taken[r.source] += r.copies * r["size"]
            target[r.source], size[r.source] = r.target, r.source_size
            largest[r.source] = max(largest[r.source], r["size"])
        assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in target)
        # water filling by hand
        names, share = sorted(target, key=lambda s: (s is None, s)), {}
        weight = {s: (1.0, 2.0, 3.0)[i % 3] for i, s in enumerate(names)}
        while True:
            open_ = [s for s in names if s not in share]
            level = (sum(size.values()) - sum(share.values())) / sum(weight[s] for s in open_)
            over = [s for s in open_ if level * weight[s] > 3 * size[s]]
            if not over:
                break
            share |= {s: 3.0 * size[s] for s in over}
        share |= {s: level * weight[s] for s in open_}
        assert target == pytest.approx(share)


def test_damaged_media_raise_one_error(spark):
    r = random.Random(9)
    whole = media.mux_pcm(bytes(range(256)) * 40)
    xiph = media.element(media.SIMPLE_BLOCK, b"\x81\x00\x05\x02" + bytes([2, 255, 1, 3]) + b"a" * 256 + b"bbb" + b"cccc")
    laced = media._HEAD + media.element(media.SEGMENT, media.element(media.CLUSTER, media._uint(media.CLUSTER_TIMESTAMP, 100) + xiph))
    bad = [media.element(media.SIMPLE_BLOCK, b"\x81\x00"), media._uint(media.CLUSTER_TIMESTAMP, 3), media.element(media.SIMPLE_BLOCK, b"\x81\x00\x05\x02\x03\xff\xff"), media.element(media.SAMPLING_FREQUENCY, b"abc"), media.element(media.CUE_TIME, b"\xff" * 9), media.element(media.CLUSTER, b"") * 3 + media.element(media.SIMPLE_BLOCK, b"\x81\x00\x05\x06\x01\xff")]
    deep = b""
    for _ in range(2000):
        deep = media.element(media.SEGMENT, deep)
    for buf in [*bad, deep]:
        with pytest.raises(media.MediaError):
            media.parse(buf)
    for _ in range(3000):
        buf = bytearray(r.choice((whole, laced)))
        for _ in range(r.randint(1, 4)):
            buf[r.randrange(len(buf))] = r.randrange(256)
        try:
            media.parse(bytes(buf[: r.randint(1, len(buf))]))
        except media.MediaError:
            pass
    files = spark.createDataFrame([(1, bytearray(whole)), (2, bytearray(bad[0])), (3, None), (4, bytearray(b""))], "doc_id long, media binary")
    table = media.packet_table(files).collect()
    assert {(x.id, x.error is None) for x in table} == {(1, True), (2, False)}
    found = sorted((x.packet, x.track, x.timestamp, x.start, x["length"], x.cluster) for x in table if x.id == 1)
    frames = [bytes(range(256)) * 4] * 10
    assert [whole[s : s + n] for _, _, _, s, n, _ in found] == frames and {x[1] for x in found} == {1}
    assert [x[2] for x in found] == [0] * 8 + [8 * 1024 * 1000 // 8000] * 2
    cues = media.parse(whole).cues
    assert [(t, whole[at : at + 4]) for t, _, at in cues] == [(0, b"\x1f\x43\xb6\x75")]


def test_clusters_of_unknown_size_end_at_elements_of_the_segment():
    cluster = b"\x1f\x43\xb6\x75\xff" + media._uint(media.CLUSTER_TIMESTAMP, 7) + media.element(media.SIMPLE_BLOCK, b"\x81\x00\x01\x00" + b"abc")
    for after in (media.TAGS, media.CHAPTERS, media.ATTACHMENTS, media.SEEK_HEAD, media.CUES, media.INFO):
        found = media.parse(media._HEAD + b"\x18\x53\x80\x67\xff" + cluster + media.element(after, b"") + cluster)
        assert [(p[1], p[3], p[4]) for p in found.packets] == [(8, 3, 0), (8, 3, 1)]


def test_top_k_refuses_vectors_whose_scores_do_not_fit(spark):
    docs = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1e17, 2.0])], "vec_id long, embedding array<float>")
    with pytest.raises(ValueError):
        topk.top_k(docs)


def test_top_k_in_waves(spark, monkeypatch):
    for name, value in (("PART_ROWS", 8), ("FIRST_WAVE", 2), ("WAVE", 1), ("SEED_ROWS", 10), ("QUERY_BLOCK", 4)):
        monkeypatch.setattr(topk, name, value)
    r = np.random.default_rng(6)
    v = r.standard_normal((150, 8)).astype(np.float32)
    v[30:90] = v[5]  # ties over many parts
    got = topk.top_k(spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>"), k=5, query_every=10).collect()
    ints = np.floor(1024 * v.astype(np.float64)).astype(int)
    want = set()
    for q in range(0, 150, 10):
        s = ints @ ints[q]
        want |= {(q, rank, i, -x) for rank, (x, i) in enumerate(sorted((-int(s[i]), i) for i in range(150) if i != q)[:5], 1)}
    assert {tuple(x) for x in got} == want and len(got) == 75


def test_pieces_of_documents(spark, rows, docs):
    """start, piece and ids_crc32 against the library; only the first piece of a cut document is short."""
    import tokenizers

    plain = tokenizers.Tokenizer.from_file(tokenise.default_path())
    got = sorted((r.doc_id, r.piece, r.start, r["length"], r.ids_crc32) for r in pack.pack_documents(docs, capacity=128).collect())
    want = []
    for doc, text, *_ in rows:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % 128 or 128
        cuts = [0, *range(first, len(ids) + 1, 128)]
        want += [(doc, i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert got == sorted(want)


def test_blocks_of_a_token_segment():
    r = np.random.default_rng(1)
    for n in (1, 255, 256, 257, 3000):
        ids = np.where(r.random(n) < 0.05, r.integers(0, 1 << 32, n), r.integers(0, 200, n)).astype(np.uint64)
        seg = token_files.encode_segment([1], np.array([n]), ids)
        assert np.array_equal(token_files.decode_segment(seg)[2], ids)
        for b in range(-(-n // 256)):
            assert np.array_equal(token_files.read_block(seg, b), ids[b * 256 : (b + 1) * 256])


def test_matching_statistics():
    """Against brute force; the streamed texts are not those indexed, and a
    statistic is seldom the length of what is left of the text."""
    r = random.Random(12)
    differ = places = 0
    for _ in range(60):
        letters = r.choice([b"ab", b"abc\0", bytes(range(256))])
        word = lambda n: bytes(r.choice(letters) for _ in range(n))
        parts = [word(r.randint(1, 30)) for _ in range(6)]
        make = lambda: b"".join(r.choice(parts) if r.random() < 0.8 else word(4) for _ in range(r.randint(1, 6)))
        texts, others = [make() for _ in range(r.randint(1, 12))], [make() for _ in range(8)] + [word(5), b"\xff"]
        index = run_length_dedup.RunLengthIndex.build(texts)
        got = {(i, at): n for which, place, length in index.statistics(others, 20) for i, at, n in zip(which.tolist(), place.tolist(), length.tolist())}
        for i, t in enumerate(others):
            for at in range(len(t)):
                n = next(n for n in range(min(20, len(t) - at), -1, -1) if any(t[at : at + n] in x for x in texts))
                if at > len(t) - 7 and (i, at) not in got:
                    continue  # looked up with the six places before the end
                assert got[i, at] == n
                differ += n != min(20, len(t) - at)
                places += 1
    assert differ > places / 3


def test_suffix_array():
    r = random.Random(13)
    for _ in range(50):
        texts = [bytes(r.choice(b"ab\0") for _ in range(r.randint(0, 40))) for _ in range(r.randint(1, 8))]
        data = np.frombuffer(b"".join([t + b"\0" for t in texts]), np.uint8)
        left = np.concatenate([np.arange(len(t), -1, -1) for t in texts])
        want = sorted(range(len(data)), key=lambda i: (data[i : i + left[i]].tolist(), i))
        assert run_length_dedup._suffix_array(run_length_dedup._keys(run_length_dedup._words(data), left), left).tolist() == want


def test_chains_of_shared_windows(spark):
    """Documents that share windows with some, not with the smallest, of their group."""
    r = random.Random(14)
    anchor = "the very same words stand here"
    ends = [["".join(r.choice("abcdefgh ") for _ in range(60)) for _ in range(4)] for _ in range(2)]
    texts = {i: f"{r.choice(ends[0])}{anchor}{r.choice(ends[1])} {i}" for i in range(60)}
    first, want = {}, {}
    for doc, text in sorted(texts.items()):
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first.setdefault(b[i : i + 50], doc) != doc:
                gone[i : i + 50] = True
        want[doc] = int(gone.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
    got = run_length_dedup.run_length_digest(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)).collect()
    assert {x.doc_id: (x.n_removed, x.kept_sha256) for x in got} == want


def test_automata_locate_what_the_passages_do_not_place():
    """A document without passages of its own loses what its block's automaton
    finds there, and places in passages are those of the first copy only."""
    from veilframe.llm.passages import Stretches

    r = random.Random(15)
    words = [f"w{i}" for i in range(60)]
    line = [r.choice(words) for _ in range(40)]
    other = [r.choice(words) for _ in range(25)]
    s = Stretches(np.array([1, 1, 2], np.uint64), np.array([3, 8, 9]), np.array([5, 0, 0], np.int32), np.array([21, 21, 6], np.int32), [" ".join(x).encode() for x in (line, line, other)])
    got = phrase_dedup.confirm(s)
    assert got.doc.tolist() == [3, 8] and got.first_doc.tolist() == [3, 3] and got.first_start.tolist() == [5, 5] and got.windows.tolist() == [21, 21] and got.text == [" ".join(line).encode()] * 2
    head = b"".join(x.astype(k).tobytes() for x, k in zip((got.first_doc[:1], got.first_start[:1], got.windows[:1], np.array([len(got.text[0])])), ("<i8", "<i4", "<i4", "<i4")))
    texts = [" ".join([*other, *line]), "\n".join(line[:30]) + " x", " ".join(line[10:]) + "\t" + " ".join(line), " ".join(line[:19])]
    block = phrase_dedup._block([t.encode() for t in texts])
    got = phrase_dedup.locate(block, np.array([3, 4, 8, 9]), [None, None, (1).to_bytes(4, "little") + head + got.text[0], None])
    assert set(zip(*(x.tolist() for x in got))) == {(0, 25, 40), (2, 30, 40)}
    texts[0] = " ".join([*other[:5], *line])  # where the passage starts first
    got = phrase_dedup.locate(phrase_dedup._block([t.encode() for t in texts]), np.array([3, 4, 8, 9]), [None, None, (1).to_bytes(4, "little") + head + got_text(line), None])
    assert set(zip(*(x.tolist() for x in got))) == {(2, 30, 40)}


def got_text(line):
    return " ".join(line).encode()


def _near_by_brute_force(texts):
    sets = {}
    for doc, text in texts.items():
        w = (text or "").lower().split()
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    root = {d: d for d in sets}
    for _ in range(6):
        for a in sets:
            for b in sets:
                if a != b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    return {(d, len(s), root[d], root[d] == d) for d, s in sets.items()}


@pytest.mark.parametrize(("block", "stars"), [(1000, 0), (3, 0), (2, 1), (40, 0)])
def test_keys_of_several_components(spark, monkeypatch, block, stars):
    """A template whose texts share bands, some of them near copies: large keys
    with many components, with and without stars before the last step."""
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    monkeypatch.setattr(near_dedup, "STARS", stars)
    r = random.Random(16)
    words = [f"t{i}" for i in range(90)]
    texts = {}
    for i in range(70):
        own = list(words)
        at = r.randrange(60)
        own[at : at + (12 if i % 2 else 4)] = [f"x{r.randint(0, 3) if i % 5 else i}y{k}" for k in range(12 if i % 2 else 4)]
        texts[i] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {tuple(x) for x in near_dedup.near_duplicates(docs).collect()} == _near_by_brute_force(texts)


def test_rows_of_one_id_are_its_smallest_text(spark):
    base = " ".join(f"w{i}" for i in range(40))
    rows = [(1, base, 0), (1, "a smaller text", 1), (2, base, 2), (3, base, 3), (3, None, 4), (4, base + " more", 5), (None, base, 6), (None, base, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, twice int").repartition(2)
    got = sorted(tuple(x) for x in near_dedup.near_duplicates(docs.where("doc_id IS NOT NULL")).collect())
    assert got == [(1, 1, 1, True), (2, 36, 2, True), (3, 0, 3, True), (4, 37, 2, False)]
    assert sorted(x.twice for x in near_dedup.without_near_duplicates(docs).collect()) == [1, 2, 4, 6, 7]


def test_statistics_leave_hopeless_texts():
    r = random.Random(9)
    text = bytes(r.choices(b"abcd", k=300))
    others = [text[20:104], text[20:90] + bytes(r.choices(b"xyz", k=14)), bytes(r.choices(b"xyz", k=30)) + text[100:154], bytes(r.choices(b"xyz", k=84))]
    index = run_length_dedup.RunLengthIndex.build([text])
    every, some = ({(i, at): n for which, place, length in index.statistics(others, least=k) for i, at, n in zip(which.tolist(), place.tolist(), length.tolist())} for k in (0, 50))
    assert some.items() <= every.items() and {x for x, n in every.items() if n >= 50} == {x for x, n in some.items() if n >= 50}
    assert (3, 40) not in some and len(some) < 0.8 * len(every)


def test_first_windows():
    from veilframe.llm.passages import _Firsts

    r = random.Random(1)
    for _ in range(100):
        most, within, plain = r.choice([0, 1, 3, 1000]), r.random() < 0.5, {}
        met = _Firsts(most)
        for _ in range(4):
            text, n = bytes(r.choices(b"ab\0", k=40)), r.randint(0, 40)
            begin = np.array([r.randint(0, 20) for _ in range(n)], np.int64)
            end = begin + np.array([r.choice([1, 7, 8, 9, 20]) for _ in range(n)], np.int64)
            key = np.array([zlib.crc32(text[x:y]) % r.choice([5, 1000]) for x, y in zip(begin, end)], np.uint64)
            doc = np.sort(np.array([r.randint(0, 5) for _ in range(n)], np.int64))
            want = []
            for i, k in enumerate(key.tolist()):
                held = plain.get(k)
                if held is None and len(plain) < most:
                    plain[k] = (doc[i], text[begin[i] : end[i]])
                elif held and held[1] == text[begin[i] : end[i]] and (within or held[0] != doc[i]):
                    want.append(i)
            assert met.repeated(text, key, doc, begin, end, within).tolist() == want


def test_dense_key_in_little_memory():
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(3)
    base, n = np.arange(200), 1500
    sets = [np.sort(np.concatenate([base[r.random(200) < 0.9], 1000 + 40 * i + np.arange(r.integers(1, 40))])).astype(np.uint64) for i in range(n)]
    stray = np.arange(n) % 10 == 0
    columns = {"key": [1] * n, "block": [0] * n, "mine": [0] * n, "v": range(n), "comp": [i if stray[i] else 1 for i in range(n)], "stray": stray.tolist(), "s": [x.tobytes() for x in sets]}
    batch = pa.RecordBatch.from_pydict(columns)
    tracemalloc.start()
    links = [x for b in near_dedup._link_runs(iter([batch])) for x in zip(*(c.to_pylist() for c in b.columns))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6

    def linked(pairs):
        root = list(range(n))
        for i, j in [*pairs, *((1, i) for i in range(n) if not stray[i])]:
            a, b = root[i], root[j]
            root = [min(a, b) if x in (a, b) else x for x in root]
        return root

    one = [set(x.tolist()) for x in sets]
    fine = [(i, j) for i in np.flatnonzero(stray).tolist() for j in range(n) if j != i and 100 * len(one[i] & one[j]) >= 75 * len(one[i] | one[j])]
    assert 20 < len(links) < n and linked(links) == linked(fine)


def test_packing_keeps_few_parts():
    assert pack.CACHE_PARTS < tokenise.CACHE_PARTS
    enc = tokenise.Encoder(tokenise.default_path(), 10)
    text = " ".join(f"w{i}" for i in range(300))
    for _ in range(2):
        assert enc.encode(text).tolist() == enc.tok.encode(text, add_special_tokens=False).ids
    assert len(enc.cache) == 10


def test_workers_get_batches_of_bounded_size(spark):
    import pyarrow as pa
    from pyspark.sql import functions as F

    from veilframe.llm import common

    fresh = spark.newSession()
    text = F.repeat(F.concat(F.col("id").cast("string"), F.lit(" words ")), 600)
    docs = fresh.range(0, 2500, 1, 1).select(F.col("id").alias("doc_id"), text.alias("text"))
    assert pack.pack_documents(docs).count() >= 2500

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64()), pa.array([b.num_rows], pa.int64())], ["size", "n"])

    got = docs.mapInArrow(sizes, "size long, n long").collect()
    assert sum(r["n"] for r in got) == 2500 and max(r["size"] for r in got) < 2 * common.BATCH_BYTES

    own = spark.newSession()  # an application's own size stands
    own.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "9000000")
    quality.with_quality(own.range(3).select(F.lit("a b").alias("text")), None).collect()
    assert own.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == "9000000"


def test_tasks_without_encoding_drop_encoders_of_their_worker():
    import pyarrow as pa

    from veilframe.llm import common

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2])], ["x"])
    tokenise.encoder(tokenise.default_path(), 10).encode_many(["some words here"])
    assert list(common.lean(lambda bs: bs, encodes=True)(iter([batch]))) == [batch] and tokenise._ENCODERS
    assert list(common.lean(lambda bs: bs)(iter([batch, batch]))) == [batch, batch] and not tokenise._ENCODERS
