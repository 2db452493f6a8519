import base64
import random
import re

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import brute
from texts import TEXTS
from scorelake.llm import bpe, decontam, fertility, licenses, pii, quality, simhash, tokenfiles, toxicity, warc
from scorelake.llm.queries import ORACLES, QUERIES

JSON, RANKS = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def expected(make):
    return sorted(((i, *make(t)) for i, t in TEXTS), key=repr)


@pytest.fixture(scope="module")
def encoding():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


def test_licenses(docs, empty):
    found = licenses.scan(docs)
    assert rows_of(found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) == expected(brute.license_base)
    by_id = {r.doc_id: r for r in found.collect()}
    assert by_id[15].labels == "apache,gpl,mit" and by_id[15].burden == 2 and not by_id[15].malformed
    assert by_id[16].malformed and "cc-by-nc" in by_id[17].labels.split(",")
    assert all(0 <= r.score <= 1 for r in by_id.values()) and by_id[1].score == 0
    assert licenses.scan(empty).count() == 0


@pytest.mark.parametrize("text, postfix", [
    ("MIT", ["mit"]), ("a or b and c", ["a", "b", "c", "and", "or"]), ("(a or b) and c with e", ["a", "b", "or", "c", "e", "with", "and"]),
    ("a or", None), ("(a", None), ("a b", None), (") a", None), ("", None)])
def test_expressions(text, postfix):
    assert licenses.to_postfix(text) == postfix


def test_warc(spark, tmp_path, docs):
    long = "<p>" + "x" * 200
    pages = [(5, "u5", long), (3, "u 3", long), (3, "u 3", long), (9, None, long + "y"), (1, "u1", None), (2, "u2", "s" * 99),
             (4, "u4", "s" * 99), (None, "u", long), (7, "u7", "é" * 60), (8, "u8", "é" * 60), (6, "u6", "z" * 40_000)]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, shard string").repartition(4)
    roots = [f"file://{tmp_path}/{name}" for name in "ab"]
    for root, order in zip(roots, (frame, frame.repartition(2)), strict=True):
        warc.write(order, root, shard_bytes=1500, roll_bytes=300)
    firsts = {}
    for page, _, html in pages:
        if page is not None and len((html or "").encode()) >= 100:
            firsts[html] = min(firsts.get(html, page), page)
    want = sorted(((page, len((html or "").encode()), brute.sha(html or ""), "revisit" if firsts.get(html, page) != page else "response",
                    firsts[html] if firsts.get(html, page) != page else None) for page, _, html in pages), key=repr)
    got = warc.read(spark, roots[0])
    assert rows_of(got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")) == want
    assert {r.payload.decode() for r in got.where("record_type = 'response'").collect()} == {h or "" for _, _, h in pages}
    manifests = [rows_of(warc.manifest(spark, root)) for root in roots]
    assert manifests[0] == manifests[1] and len(manifests[0]) > 3            # equal files, whatever the partitions
    assert not (tmp_path / "a" / "_temporary").exists()
    warc.write(frame.where("false"), f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def test_token_files(spark, docs, empty, tmp_path, sf_dir):
    tokenizer = Tokenizer.from_file(JSON)
    tokenizer.encode_special_tokens = True
    want, start = [], 0
    for i, t in sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, start, len(ids), brute.crc(ids)))
        start += len(ids)
    assert rows_of(tokenfiles.roundtrip(docs, JSON)) == sorted(want, key=repr)
    assert tokenfiles.roundtrip(empty, JSON).count() == 0
    tokenfiles.write(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{tmp_path}/t", JSON, parts=1)
    import pyarrow.parquet as pq

    file = next(x for x in sorted((tmp_path / "t").glob("*.parquet")))
    meta = pq.ParquetFile(file).metadata.row_group(0)
    tokens = next(meta.column(k) for k in range(meta.num_columns) if "tokens" in meta.column(k).path_in_schema)
    assert any("DICT" in e or "DELTA" in e for e in tokens.encodings) and meta.column(1).has_offset_index and meta.column(1).has_column_index


def test_byte_bpe(docs, empty, encoding):
    def want(text):
        ids = encoding.encode_ordinary(text or "")
        return len(ids), brute.sha(",".join(map(str, ids))), brute.sha(text or "")
    assert rows_of(bpe.roundtrip(docs, RANKS, P.PATTERN)) == expected(want)
    encoded = bpe.encode(docs, RANKS, P.PATTERN)
    decoded = bpe.decode(encoded, RANKS, P.PATTERN)
    assert sorted((bytes(r.decoded) for r in decoded.collect())) == sorted((t or "").encode() for _, t in TEXTS)
    assert bpe.roundtrip(empty, RANKS, P.PATTERN).count() == 0


def test_long_words(encoding):
    """The step-by-step form for long words agrees too, with runs of one letter and with mixed ones."""
    known = bpe.codec(RANKS, P.PATTERN)
    rng = random.Random(1)
    words = ["a" * 700, "".join(rng.choice("abcde") for _ in range(600)), "ab" * 300, "é" * 200]
    for word, ids in zip(words, known.words([w.encode() for w in words]), strict=True):
        assert ids.tolist() == encoding.encode_ordinary(word)


@pytest.mark.parametrize("limit, characters", [(0, 10**6), (8, 10**6), (10**6, 60)])
def test_full_caches(encoding, limit, characters):
    """A cache that is always full gives the same ids, texts and bytes, and forgets."""
    known = bpe.codec(RANKS, P.PATTERN).__class__(RANKS, P.PATTERN, limit)
    known.characters = characters
    texts = [t or "" for _, t in TEXTS]
    for start in [*range(0, len(texts), 4)] * 3:
        part = texts[start:start + 4]
        ids, counts = known.tokens(pa.array(part))
        assert ids.tolist() == [i for t in part for i in encoding.encode_ordinary(t)]
        assert counts.tolist() == [len(encoding.encode_ordinary(t)) for t in part]
        for piece, number in known.known.items():
            assert known.raw[number] == piece.encode()
            assert known.decimal[number] == ",".join(map(str, encoding.encode_ordinary(piece))).encode()
    known._shrink()
    assert len(known.known) <= limit // 2 + 1 and known.held <= characters // 2


def test_pii(docs, empty):
    found = pii.report(docs)
    want = sorted(((i, *brute.pii(t)[0], brute.pii(t)[1]) for i, t in TEXTS), key=repr)
    assert rows_of(found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")) == want
    for r in found.collect():
        base = {x for i, t in TEXTS if i == r.doc_id for x in brute.pii(t)[2].split(",")}
        assert base & set(r.spans.split(",")) == base or base == {""}
    assert pii.report(empty).count() == 0
    redacted = {r.doc_id: r for r in pii.redact(docs.drop("spans")).collect()}
    assert "4111 1111" not in redacted[8].text and "[CARD]" in redacted[8].text and redacted[1].text is None
    assert redacted[13].text == "Hello World" and redacted[13].kind == "x"


def test_pii_patterns_on_random_texts(spark):
    rng = random.Random(7)
    texts = ["".join(rng.choice(["1", "23", ".", "-", " ", "+", "@", "a", "b.c", "(", ")", "4111111111111111", "é"]) for _ in range(40)) for _ in range(400)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.base_sha256 for r in pii.report(frame).collect()}
    assert all(got[k] == brute.pii(t)[1] for k, t in enumerate(texts))


def test_simhash(docs, empty, texts, spark):
    every = sorted(TEXTS, key=lambda x: (x[0] is None, x[0] or 0))
    fps = [brute.simhash(t) for _, t in every]
    want = sorted(((i, fps[k], every[root][0]) for k, ((i, _), root) in enumerate(zip(every, brute.classes(fps), strict=True))), key=repr)
    got = sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == want
    assert simhash.near_duplicates(empty).count() == 0
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert len(kept) == len(set(kept)) == len({x[2] for x in want})


def test_shards_lose_no_pair():
    """Trees of any shape and dense groups give the classes of all pairs."""
    rng = np.random.default_rng(3)
    centre = rng.integers(0, 2**64, 300, dtype=np.uint64)
    near = [c ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))) for c in centre for _ in range(3)]
    dense = [centre[0] ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, 3, replace=False))) for _ in range(1500)]
    fps = np.unique(np.concatenate([centre, np.array(near + dense, np.uint64)]))
    want = brute.classes([int(x) for x in fps])
    local = simhash.local_classes(fps.view(np.int64))
    assert local.tolist() == want
    for depth in (0, 3, 6):
        parent = list(range(len(fps)))

        def root(k):
            while parent[k] != k:
                k = parent[k]
            return k

        for k, (_, width) in enumerate(simhash.SEGMENTS):
            codes = simhash._segment(fps.view(np.int64), k)
            index, leaf = simhash.route(codes, simhash.fit_tree(codes[:100], width, depth, 1))
            for shard in np.unique(leaf):
                own = np.sort(index[leaf == shard])
                for a, b in zip(own, own[simhash.local_classes(fps[own].view(np.int64))], strict=True):
                    x, y = root(int(a)), root(int(b))
                    parent[max(x, y)] = min(x, y)
        assert [root(k) for k in range(len(fps))] == want


def test_decontamination(spark, docs, empty):
    items = [(1, "one two three four five six seven eight nine ten"), (2, "Hello, world!"), (3, None), (4, ""), (5, "Hello World"),
             (6, "two three four five six seven eight nine ten eleven twelve"), (7, "nowhere at all"), (8, "xyzzy " * 12), (None, "same")]
    frame = spark.createDataFrame([(*x, "x") for x in items], "item_id long, text string, words string")
    got = decontam.report(decontam.find(docs, frame))
    named = [(i, t) for i, t in items if i is not None]
    rows = rows_of(got)
    plain = sorted(((i, *brute.contamination(t, named)) for i, t in TEXTS if i not in (5, 6)), key=repr)
    assert [r for r in rows if r[0] not in (5, 6)] == plain
    assert decontam.find(empty, frame).count() == 0
    assert {r.n_hit for r in decontam.find(docs, frame.where("false")).collect()} == {0}
    kept = decontam.keep_clean(docs, frame)
    assert kept.columns == docs.columns and {11, 12, 13, 14, 4}.isdisjoint({r.doc_id for r in kept.collect()})


def test_fertility(docs, empty, encoding):
    found = fertility.judge(docs, RANKS, P.PATTERN)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows_of(found.select("doc_id", *names)) == expected(brute.rules)
    for r in found.collect():
        assert not (r.base_failed and r.kept)
        text = next(t for i, t in TEXTS if i == r.doc_id)
        assert r.n_tokens == len(encoding.encode_ordinary(text or ""))
    assert fertility.judge(empty, RANKS, P.PATTERN).count() == 0


def test_bands_reject_outliers_only(spark):
    good = [(k, " ".join(f"{a}{b}" for a in ("the", "of", "and") for b in range(k % 7, k % 7 + 20))) for k in range(80)]
    bad = [(99, " ".join("ὠ0€☃"[j % 4] + chr(0x1F300 + j) for j in range(40)) + " plain" * 1 + " word" + " text" * 1
            + " ".join(chr(0x1F400 + j) for j in range(30)) + " latin letters here to set the script of it all once more")]
    frame = spark.createDataFrame(good + bad, "doc_id long, text string")
    got = {r.doc_id: r for r in fertility.judge(frame, RANKS, P.PATTERN, least=2).collect()}
    assert all(got[k].kept for k in range(80))


def test_toxicity(spark, docs, empty):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["calm", "sea", "tree", "road", "lamp"]) for _ in range(30)) + (" vile" * (1 + k % 5) if k % 7 == 0 else "")) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 7 == 0)) for k, _ in rows if k % 2] + [(1001, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(frame, labels)
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    assert model["words"] == ["vile"] and (np.diff(model["thresholds"]) > 0).all()
    assert all(got[k].toxic == (k % 7 == 0) for k in got)
    assert got[28].severity > got[0].severity > got[1].severity             # five, one and no marker words
    assert toxicity.fit(frame, labels.where("toxic = 0")) is None
    assert toxicity.score(docs, None).where("toxic").count() == 0
    assert toxicity.score(empty, model).count() == 0 and toxicity.score(docs, model).count() == len(TEXTS)
    assert {r.doc_id for r in toxicity.keep_clean(frame, labels).collect()} == {k for k, _ in rows if k % 7}


def test_quality(spark, docs, empty, sf_dir):
    d, labels = (spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/{t}.parquet") for t in ("documents", "labels"))
    scored = quality.judge(d, labels)
    pairs = scored.join(labels, "doc_id").where("held_out").select("score", "quality").collect()
    good, bad = ([r.score for r in pairs if r.quality == y] for y in (1, 0))
    assert np.mean([[g > b for b in bad] for g in good]) > 0.95
    counted = quality.statistics(docs)
    none = quality.fit(counted, labels.where("false"))
    assert none["rules"] == [] and quality.score(counted, none).count() == len(TEXTS)
    assert quality.score(quality.statistics(empty), none).count() == 0


def test_paths():
    text = ("RandomForest\n  Tree 0 (weight 1.0):\n    If (feature 1 <= 0.5)\n     If (feature 2 <= 3.0)\n      Predict: 0.0\n"
            "     Else (feature 2 > 3.0)\n      Predict: 1.0\n    Else (feature 1 > 0.5)\n     Predict: 1.0\n")
    a, b, c = (1, "<=", 0.5), (2, "<=", 3.0), (2, ">", 3.0)
    assert quality.paths(text) == [(a,), (a, b), (a, c), ((1, ">", 0.5),)]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        db.execute(f"create view {table} as select * from read_parquet('{sf_dir}/{table}.parquet')").fetchall()
    want = db.sql(ORACLES[name]).to_arrow_table().to_pylist()
    got = [r.asDict() for r in QUERIES[name](spark, sf_dir).collect()]
    assert sorted(map(repr, (sorted(r.items()) for r in got))) == sorted(map(repr, (sorted(r.items()) for r in want)))


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept, model = docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.score(docs, model).where("toxic").collect()}
    ids = sorted(set(texts) - toxic)
    roots = brute.classes([brute.simhash(texts[k]) for k in ids])
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [k for n, k in enumerate(ids) if roots[n] == n and not brute.contamination(texts[k], items)[4]]
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert sorted(got) == clean
    for k in clean:
        if not brute.pii(texts[k])[2] and not re.search(r"(?i)token|secret|password|key|[0-9]-[0-9]|\b(Mr|Mrs|Dr)\b", texts[k]):
            assert got[k].decoded_sha256 == brute.sha(texts[k])
    assert kept.columns == corpus_pipeline.STAGES[3][1](spark, docs, sf_dir).columns
