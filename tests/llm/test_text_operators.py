"""Rules, classifier, BPE, suffix dedup, packing and language ID against plain versions and on odd rows."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, langid, packing, quality, registry, rules, suffix_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}x{i}" for i in range(30_000))


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty and very long texts, repeated rows, ties, nulls in every other column, clashing extra columns."""
    texts = [None, "", "   \n\t ", LONG, "same text here " * 30, "same text here " * 30, "Ünïcödé 日本語 🎉 ​ text\n\n\nline\nline", "a" * 3000, "\x00 control \x07", "x"]
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else "src1", len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[4])
    rows.append((None, "a row without an id " * 20, "en", "src1", 400))
    df = spark.createDataFrame(rows, DOCS)
    for extra in ("id", "ids", "words", "h", "key", "fp", "rep", "shard", "doc", "first", "end", "_text", "failed", "kept", "host", "path", "score", "n_words", "component_id"):
        df = df.withColumn(extra, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# --- rules ---


def _plain_measures(text):
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_measures_match_plain_python(spark, odd, sf):
    r = random.Random(3)
    made = [" ".join(r.choice("a b c d e f".split()) for _ in range(r.randint(0, 60))) for _ in range(150)]
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).union(spark.createDataFrame(list(enumerate(made, 10_000)), "doc_id long, text string"))
    texts = docs.collect()
    got = rules.ledger(docs).select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
    assert sorted(map(tuple, got)) == sorted(_plain_measures(t) for _, t in texts)


def test_policies_and_ablations(spark, odd, none):
    book = rules.judged(rules.ledger(odd))
    kept = {r.doc_id for r in book.where("kept").collect()}
    assert kept == {3} and rules.keep(odd).columns == odd.columns and {r.doc_id for r in rules.keep(odd).collect()} == kept
    rows = {r.rule: r for r in rules.ablations(rules.ledger(odd)).collect()}
    failed = [r.failed for r in book.collect()]
    for name, (bit, _) in rules.RULES.items():
        assert rows[name].fails == sum(f >> bit & 1 for f in failed) and rows[name].fails_alone == sum(f == 1 << bit for f in failed)
    assert rules.judged(rules.ledger(none)).count() == 0 and rules.keep(none).count() == 0 and rules.ablations(rules.ledger(none)).count() == len(rules.RULES)


# --- classifier ---


def test_classifier_on_labelled_rows(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(docs, labels).join(labels, "doc_id").collect()
    good = [r for r in rows if r.quality == 1 and r.toxic == 0]
    bad = [r for r in rows if r.quality == 0]
    assert sum(r.kept for r in good) / len(good) > 0.97 and sum(r.kept for r in bad) / len(bad) < 0.1


def test_sparse_sites_stay_near_the_global_rate(spark):
    rows = [(f"h{i}", "p", int(j >= i * 4), 0) for i in range(5) for j in range(40)] + [("tiny", "p", 0, 0)]
    shrunk, overall = quality.sites(spark.createDataFrame(rows, "host string, path string, quality int, toxic int"))
    rate = {r.host: r.quality_rate for r in shrunk.collect()}
    assert abs(rate["h0"] - 1) < 0.1 and rate["h4"] < rate["h2"] < rate["h0"] and rate["tiny"] > 0.2 and 0 < overall["toxic"] < 0.05


def test_classifier_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad, toxic = [r.kept for r in rows if r.quality == 1 and r.toxic == 0], [r.kept for r in rows if r.quality == 0], [r.kept for r in rows if r.toxic == 1]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.05 and sum(toxic) / len(toxic) < 0.12


def test_posteriors_match_a_plain_computation(spark):
    import math

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = quality.classify(docs, labels).collect()
    site, told = {r.doc_id: (r.host, r.path) for r in rows}, labels.collect()
    for name, ev, out in (("quality", "ev_good", "p_good"), ("toxic", "ev_toxic", "p_toxic")):
        paths, hosts = {}, {}
        for x in told:
            if x.doc_id in site and x[name] is not None:
                for table, key in ((paths, site[x.doc_id]), (hosts, site[x.doc_id][0])):
                    hits, n = table.get(key, (0, 0))
                    table[key] = (hits + (x[name] != 0), n + 1)
        hits, n = (sum(v[i] for v in hosts.values()) for i in (0, 1))
        rate = (hits + 1) / (n + 2)

        def strength(table, rate=rate):
            variance = rate * (1 - rate)
            excess = sum((h - m * rate) ** 2 - m * variance for h, m in table.values())
            pairs = sum(m * (m - 1) for _, m in table.values())
            return 500.0 if not pairs or excess <= 0 else min(max(1 / min(excess / (pairs * variance), 0.9) - 1, 5.0), 500.0)

        a, b = strength(hosts), strength(paths)
        for r in rows:
            shift = 0.0
            if r.host in hosts and (r.host, r.path) in paths:
                of_host = (hosts[r.host][0] + a * rate) / (hosts[r.host][1] + a)
                p = (paths[r.host, r.path][0] + b * of_host) / (paths[r.host, r.path][1] + b)
                shift = math.log(p / (1 - p)) - math.log(rate / (1 - rate))
            odds = math.log(rate / (1 - rate)) + max(-quality.SITE_CAP, min(quality.SITE_CAP, shift)) + r[ev]
            assert abs(r[out] - 1 / (1 + math.exp(-odds))) < 1e-9


def test_classifier_on_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(0, 1, 0), (1, None, 1), (3, 1, None), (4, 0, 0), (4, 1, 0), (None, 1, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd, labels).collect()
    assert len(got) >= odd.count() and all(0 <= r.p_good <= 1 and 0 <= r.p_toxic <= 1 for r in got)
    unlabelled = quality.classify(odd, labels.where("false"))
    assert unlabelled.where("kept").count() == odd.count() and quality.keep(odd, labels.where("false")).columns == odd.columns
    assert quality.classify(none, labels).count() == 0 and quality.keep(none, labels).count() == 0


# --- BPE ---

RANKS = P.path("byte_bpe_multi_50k.tiktoken")


def _tiktoken():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_matches_the_library(spark, odd, none, sf):
    library = _tiktoken()
    r = random.Random(2)
    strange = ["".join(r.choice("abcdeth nrs'.,!\n\té日🎉0123") for _ in range(r.randint(0, 300))) for _ in range(200)] + ["ab" * 3000, "theandof" * 400, "<|endoftext|>", "don't WE'LL I'm"]
    docs = odd.select("doc_id", "text").union(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")).union(spark.createDataFrame(list(enumerate(strange, 50_000)), "doc_id long, text string"))
    texts = docs.collect()
    want = [(d, *_digest(library.encode_ordinary(t or ""), t or "")) for d, t in texts]
    key = lambda r: (r[0] is None, *[x or 0 for x in r])
    assert sorted(map(tuple, bpe.digest(docs, RANKS, P.PATTERN).collect()), key=key) == sorted(want, key=key)
    ids = bpe.encode(docs, RANKS, P.PATTERN)
    assert sorted(((x.doc_id or -1, x.text) for x in bpe.decode(ids, RANKS, P.PATTERN).collect())) == sorted((d or -1, t or "") for d, t in texts)
    assert bpe.digest(none, RANKS, P.PATTERN).count() == 0


def _digest(ids, text):
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()


# --- suffix dedup ---


def _brute(docs, length=suffix_dedup.LENGTH):
    seen = {}
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            seen.setdefault(b[i : i + length], []).append((d, i))
    gone = {d: np.zeros(len((t or "").encode()), bool) for d, t in docs}
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                gone[d][i : i + length] = True
    out = []
    for d, t in docs:
        b, m = np.frombuffer((t or "").encode(), np.uint8), gone[d]
        runs = int((np.diff(np.concatenate([[0], m.astype(int)])) == 1).sum())
        out.append((d, len(b), int(m.sum()), runs, hashlib.sha256(b[~m].tobytes()).hexdigest()))
    return sorted(out)


def _passages(seed, n, hot):
    r = random.Random(seed)
    noise = lambda k, al="abcdefg hij éklm": "".join(r.choice(al) for _ in range(k))
    shared = [noise(r.choice([150, 199, 200, 201, 230, 300, 400, 900])) for _ in range(12)]
    docs = ["".join(r.choice([noise(r.randint(0, 300)), r.choice(shared), r.choice(shared)[r.randint(0, 60) :]]) for _ in range(r.randint(1, 6))) for _ in range(n)]
    everywhere = noise(260)
    docs += [noise(r.randint(1, 150)) + everywhere + noise(r.randint(1, 150)) for _ in range(hot)]
    docs += ["a" * 1000, "ab" * 400, "xyz" * 67, "xyz" * 66, None, "", docs[0], docs[0], "q" * 199 + "w", "Orre " * 300 + "tail", "Orre " * 90 + "different tail " * 20]
    return list(enumerate(docs))


def test_suffix_dedup_matches_brute_force(spark):
    docs = _passages(5, 150, 60)
    assert sorted(map(tuple, suffix_dedup.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect())) == _brute(docs)


def test_suffix_dedup_of_a_passage_in_very_many_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SHARD", 16)
    docs = _passages(8, 40, 220)
    # the number of shards is set where the plan is built, on the driver
    assert sorted(map(tuple, suffix_dedup.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect())) == _brute(docs)


def test_suffix_dedup_broadcasts_no_texts_of_small_files(spark, monkeypatch, tmp_path):
    """Copies take a small part of their bytes in a file, and Spark would take that for the table's size."""
    docs = [(i, f"a text of {i % 2} that is found again in many copies. " * 6) for i in range(40)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(path)
    joins, write = {}, suffix_dedup.stored

    def broadcast(df):
        return [x for x in df._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastHashJoin" in x]

    def recorded(df, name):
        joins[name] = broadcast(df)
        return write(df, name)

    monkeypatch.setattr(suffix_dedup, "stored", recorded)
    found = suffix_dedup.digest(spark.read.parquet(path))
    assert joins["again"] == [] and broadcast(found) == []
    assert not any("Inner" in x for x in joins["found"])  # the texts' join; that with the few common anchors is an outer one
    assert sorted(map(tuple, found.collect())) == _brute(docs)


def test_suffix_dedup_reads_texts_in_small_batches(spark, none):
    rows, vectored = "spark.sql.parquet.columnarReaderBatchSize", "parquet.hadoop.vectored.io.enabled"
    try:
        for given, kept in (((None, None), ("512", "false")), (("4096", None), ("512", "false")), (("100", "true"), ("100", "true"))):
            for name, value in zip((rows, vectored), given, strict=True):
                spark.conf.unset(name) if value is None else spark.conf.set(name, value)
            suffix_dedup.digest(none)
            assert (spark.conf.get(rows), spark.conf.get(vectored)) == kept
    finally:
        spark.conf.unset(rows)
        spark.conf.unset(vectored)


def test_suffix_dedup_of_texts_over_a_segment(spark):
    r = random.Random(1)
    big = "".join(r.choice("abcdefghij klmnop") for _ in range(suffix_dedup.SEGMENT + 5000))
    docs = [(1, big), (2, big[suffix_dedup.SEGMENT - 700 : suffix_dedup.SEGMENT + 900] + "!"), (3, "z" * 10)]
    got = {x.doc_id: x for x in suffix_dedup.digest(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert (got[1].n_removed, got[1].n_spans) == (1600, 1) and got[2].n_removed == 1600 and got[3].n_removed == 0


def test_suffixes_are_sorted():
    r = random.Random(2)
    data = np.frombuffer("".join(r.choice("ab") for _ in range(600)).encode(), np.uint8)
    start = np.arange(0, 500)
    end = np.minimum(start + 100, 600)
    group = np.repeat(np.arange(5), 100)
    s = suffix_dedup.Suffixes(suffix_dedup.Prefixes(data), start, end, group)
    raw = data.tobytes()
    for g in range(5):
        own = s.order[g * 100 : g * 100 + 100]
        texts = [raw[start[i] : end[i]] for i in own]
        assert texts == sorted(texts) and set(own) == set(range(g * 100, g * 100 + 100))
    best, mate = s.nearest()
    assert all(raw[start[i] : start[i] + best[i]] == raw[start[mate[i]] : start[mate[i]] + best[i]] for i in range(500))


def test_rows_that_share_an_id_or_have_none(spark):
    r = random.Random(11)
    noise = lambda n: "".join(r.choice("abcdefghij klm") for _ in range(n))
    shared = noise(300)
    rows = [(1, noise(500)), (1, noise(80) + shared + noise(50)), (2, shared), (None, "x" + shared), (None, noise(400)), (None, None), (3, noise(250)), (3, noise(250))]
    got = suffix_dedup.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(rows[i][0], *x[1:]) for i, *x in [(x[0], *x) for x in _brute([(i, t) for i, (_, t) in enumerate(rows)])]]
    key = lambda x: (x[0] is None, *[y or 0 for y in x])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    clean = suffix_dedup.cleaned(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(x.text or "" for x in clean.where("doc_id is null").collect()) == sorted(["", "x", rows[4][1]])


def test_windows_of_one_hash_are_told_apart_by_their_bytes():
    r = random.Random(3)
    one, two = ("".join(r.choice("abcd") for _ in range(260)) for _ in range(2))
    data = np.frombuffer((one + two + one + two[:210] + "!" + two[211:]).encode(), np.uint8)
    start = np.concatenate([np.arange(61) + k for k in (0, 260, 520, 780)])
    real = np.array([hash(data[a : a + suffix_dedup.LENGTH].tobytes()) & 0xFFFFFFFF for a in start], np.uint64)
    for window in (real, np.zeros(len(start), np.uint64), real % np.uint64(7), real % np.uint64(2)):  # the later ones collide
        order, new = suffix_dedup.alike(data, start, window)
        group = np.empty(len(start), np.int64)
        group[order] = np.cumsum(new)
        texts = [data[a : a + suffix_dedup.LENGTH].tobytes() for a in start]
        for i in range(0, len(start), 7):
            assert [group[i] == group[j] for j in range(len(start))] == [texts[i] == t for t in texts]


def test_cleaned_texts(spark, odd, none):
    clean = suffix_dedup.cleaned(odd.dropDuplicates(["doc_id"]))
    assert clean.columns == odd.columns
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert texts[0] is None and texts[4] == "" and texts[7] == "" and texts[3].startswith("word0x0") and texts[6].startswith("Ünï")
    cut = "é" * 99 + "x" + "ab" * 60  # 200-byte windows start inside characters
    got = {r.doc_id: r.text for r in suffix_dedup.cleaned(spark.createDataFrame([(1, "1é" + cut), (2, "2è" + cut)], "doc_id long, text string")).collect()}
    assert got[1].startswith("1") and len(got[1]) <= 2
    assert suffix_dedup.digest(none).count() == 0 and suffix_dedup.cleaned(none).count() == 0


# --- packing ---

VOCABULARY = P.path("byte_bpe_50k.json")


def _library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    return [[*e.ids, 0] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def _check_packed(rows, texts, width=packing.WIDTH):
    ids = {}
    for (d, _), own in zip(texts, _library([t for _, t in texts]), strict=True):
        ids[d] = own
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
    for d, own in ids.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at
            at += r.length
        assert at == len(own)
    full = 0
    for s in by_sequence.values():
        at = 0
        for r in sorted(s, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= width
        full += at == width
    assert full >= len(by_sequence) - 1 and sorted(by_sequence) == list(range(len(by_sequence)))


def test_ids_of_texts_that_spell_an_added_token(spark):
    from tokenizers import Tokenizer

    texts = ["<|endoftext|>", "one <|endoftext|> two<|endoftext|><|endoftext|>", "<|endoftext| >", "no such token, don't", " <|endoftext|>\n\n x"]
    want = [e.ids for e in Tokenizer.from_file(VOCABULARY).encode_batch(texts, add_special_tokens=False)]
    encode, top = packing.encoder(VOCABULARY, P.PATTERN)
    assert [list(encode(t)) for t in texts] == want and 50256 in want[0] and top == 50257
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), VOCABULARY, P.PATTERN).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == {i: len(w) + 1 for i, w in enumerate(want)}


def test_packing_covers_every_id_once(spark, odd, none, monkeypatch):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").union(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id + 1000", "text"))
    _check_packed(packing.pack(docs, VOCABULARY, P.PATTERN).collect(), [tuple(r) for r in docs.collect()])
    assert packing.pack(none, VOCABULARY, P.PATTERN).count() == 0
    spelled = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "<|endoftext|>" * 700)], "doc_id long, text string")
    _check_packed(packing.pack(spelled, VOCABULARY, P.PATTERN).collect(), [tuple(r) for r in spelled.collect()])
    nameless = packing.pack(spelled.selectExpr("cast(null as long) as doc_id", "text"), VOCABULARY, P.PATTERN).collect()
    assert sum(r.length for r in nameless) == 706 and {r.doc_id for r in nameless} == {None}
    alike = spark.createDataFrame([(i, "one text for all of them") for i in range(500)], "doc_id long, text string")
    _check_packed(packing.pack(alike, VOCABULARY, P.PATTERN).collect(), [tuple(r) for r in alike.collect()])
    monkeypatch.setattr(packing, "RANGE", 50)  # more ranges than partitions, and than documents
    _check_packed(packing.pack(docs, VOCABULARY, P.PATTERN).collect(), [tuple(r) for r in docs.collect()])
    twice = packing.pack(alike.limit(1).union(alike.limit(1)), VOCABULARY, P.PATTERN).collect()
    assert sum(r.length for r in twice) == 2 * twice[0].doc_tokens


def test_hilbert_order():
    bits, n = 3, 2
    grid = np.array([(x, y) for x in range(1 << bits) for y in range(1 << bits)])
    index = packing.hilbert(grid, bits)
    assert sorted(index.tolist()) == list(range(1 << (bits * n)))
    path = grid[np.argsort(index)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()  # neighbours on the curve touch


# --- language ID ---


def test_languages_held_out(spark, odd, none):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = registry.op6_language_id(spark, sf).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.98 and all(0 <= r.score <= 1 for r in rows)
    sample = langid.learn(docs.where(langid.fold() != langid.HELD_OUT))
    got = {r.doc_id: r for r in langid.identify(odd, sample).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (0, 1, 2)) and len(got) == 11
    assert langid.identify(none, sample).count() == 0 and langid.learn(none) == {}
    assert {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}
    assert {zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows} == {True}


def test_automaton_finds_longest_matches():
    model = langid.Model({"x": ["abcabcabd"], "y": ["xyz"]})
    size, has, counts = model.phrases(["abcabd", "zzz", "", "ab xyz"])
    assert size.tolist() == [6, 3, 0, 6] and has.tolist() == [True, True, False, True]
    assert counts[0, 0] == 1 and counts[1, 1] == 3 and counts[0, 1] > counts[0, 0]


def _plain_phrases(text, learned):
    """Greedy longest matches by substring search; a symbol that isn't in the learned text is two phrases."""
    at = n = 0
    while at < len(text):
        end = at
        while end < len(text) and text[at : end + 1] in learned:
            end += 1
        at, n = max(end, at + 1), n + (1 if end > at else 2)
    return n


@pytest.mark.parametrize("dense", [langid.DENSE, 0])
@pytest.mark.parametrize("block", [langid.BLOCK, 7])
def test_phrases_match_plain_cross_parsing(monkeypatch, dense, block):
    monkeypatch.setattr(langid, "DENSE", dense)
    monkeypatch.setattr(langid, "BLOCK", block)
    r = random.Random(9)
    spell = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    han = [chr(0x4E00 + i) for i in range(900)]
    samples = {"ab": ["aaa" + spell("ab ", 300)], "abc": [spell("abc", 400)], "han": ["".join(r.choice(han) for _ in range(2000))], "b": ["bbbbb"]}
    model = langid.Model(samples)
    texts = [spell("ab ", 500), "a" * 2000, "ab" * 900, "b" * 1234, "", "q", spell("abcq ", 700), "".join(r.choice(han) for _ in range(600)), samples["han"][0][100:900], "a ? b", "bb" + "q" * 300 + "b" * 600]
    _, _, counts = model.phrases(texts)
    plain = lambda t: "".join(" " if x == 0 else chr(x) for x in langid.symbols([t])[0].tolist())
    for i, text in enumerate(texts):
        for k, lang in enumerate(model.languages):
            assert counts[i, k] == _plain_phrases(plain(text), plain(samples[lang][0])), (text[:20], lang)


def test_languages_of_many_letters_are_told_apart(spark):
    r = random.Random(4)
    scripts = {f"l{k}": [chr(0x4E00 + 2500 * k + i) for i in range(2500)] for k in range(4)}
    write = lambda k: "".join(r.choice(scripts[k]) for _ in range(300))
    rows = [(i, write(k), k) for i, k in enumerate([*scripts] * 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = langid.learn(docs.where("doc_id < 160"))
    got = {x.doc_id: x.lang_pred for x in langid.identify(docs, sample).collect()}
    assert all(got[i] == k for i, _, k in rows)
